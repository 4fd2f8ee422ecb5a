"""Operator 7: license detection by ordered signature rules, in DataFrame functions only.

Texts become words in lower case with single spaces between them. Each of the rules (``RULES_TEXT``) has a
keyword, a literal that all its matches contain: the keywords that a text contains
say which rules are matched against it, so that most texts meet no pattern. Matches become intervals of the text.
An interval that lies within one of higher priority, or within a longer one of the
same priority, is suppressed; the labels of the others are the result.

Beside them stand the base phrases, whose places are all counted.

Cases: null texts have no words, no labels and score 0; equal texts get equal results; repeated rows give a
row each; very long texts are read whole; an empty table gives an empty result; only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Rules as priority, label, keyword, pattern. Patterns are over words in lower case between single spaces;
# a keyword is a literal that every match of the pattern contains.
RULES_TEXT = """
9 mit|identifier mit|spdx licen[cs]e identifier mit
9 apache|identifier apache|spdx licen[cs]e identifier apache [12] [01]
9 gpl|identifier gpl|spdx licen[cs]e identifier gpl [123] 0(?: only| or later)?
9 lgpl|identifier lgpl|spdx licen[cs]e identifier lgpl [23] [01](?: only| or later)?
9 agpl|identifier agpl|spdx licen[cs]e identifier agpl [13] 0(?: only| or later)?
9 bsd|identifier bsd|spdx licen[cs]e identifier bsd(?: [0234] clause)?
9 bsd|identifier 0bsd|spdx licen[cs]e identifier 0bsd
9 mpl|identifier mpl|spdx licen[cs]e identifier mpl [12] [01]
9 epl|identifier epl|spdx licen[cs]e identifier epl [12] 0
9 isc|identifier isc|spdx licen[cs]e identifier isc
9 cc0|identifier cc0|spdx licen[cs]e identifier cc0 1 0
9 cc-by|identifier cc by|spdx licen[cs]e identifier cc by [1-4] [05]
9 cc-by-sa|identifier cc by sa|spdx licen[cs]e identifier cc by sa [1-4] [05]
9 unlicense|identifier unlicense|spdx licen[cs]e identifier unlicense
9 zlib|identifier zlib|spdx licen[cs]e identifier zlib
9 boost|identifier bsl|spdx licen[cs]e identifier bsl 1 0
9 artistic|identifier artistic|spdx licen[cs]e identifier artistic [12] 0
9 ofl|identifier ofl|spdx licen[cs]e identifier ofl 1 [01]
9 eupl|identifier eupl|spdx licen[cs]e identifier eupl 1 [012]
9 wtfpl|identifier wtfpl|spdx licen[cs]e identifier wtfpl
9 ncsa|identifier ncsa|spdx licen[cs]e identifier ncsa
9 postgresql|identifier postgresql|spdx licen[cs]e identifier postgresql
9 python|identifier psf|spdx licen[cs]e identifier psf 2 0
9 mulan|identifier mulanpsl|spdx licen[cs]e identifier mulanpsl [12] 0
8 apache|apache license version|licen[cs]ed under (?:the terms of )?the apache license version [12] [01]
8 apache|apache license|licen[cs]ed under (?:the terms of )?(?:the )?apache license(?: 2 0)?
8 apache|under the apache|(?:released|distributed|available|provided|published|licen[cs]ed) under the apache(?: software)?(?: license)?(?: version)?(?: 2(?: 0)?)?
8 apache|terms of the apache|under (?:the )?terms of the apache(?: software)?(?: license)?(?: version)?(?: [12] [01])?
8 mit|under the mit|(?:released|distributed|available|provided|published|licen[cs]ed) under the mit(?: open source)?(?: licen[cs]e)?
8 mit|under mit|(?:released|distributed|available|provided|published|licen[cs]ed) under mit(?: licen[cs]e)?
8 mit|terms of the mit|under (?:the )?terms of the mit(?: licen[cs]e)?
8 expat|under the expat|(?:released|distributed|available|licen[cs]ed) under the expat(?: licen[cs]e)?
8 x11|under the x11|(?:released|distributed|available|licen[cs]ed) under the x11(?: licen[cs]e)?
8 gpl|under the gpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the gpl(?: licen[cs]e)?(?: version)?(?: v?[123](?: 0)?)?(?: or later)?
8 gpl|under the gnu gpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the gnu gpl(?: version)?(?: v?[123](?: 0)?)?(?: or later)?
8 gpl|under the gnu general public|(?:released|distributed|available|provided|published|licen[cs]ed) under the gnu general public licen[cs]e(?: version)?(?: [123](?: 0)?)?
8 gpl|terms of the gpl|under (?:the )?terms of the gpl(?: version)?(?: v?[123](?: 0)?)?
8 gpl|terms of the gnu gpl|under (?:the )?terms of the gnu gpl(?: version)?(?: v?[123](?: 0)?)?
8 gpl|terms of the gnu general public|under (?:the )?terms of the gnu general public licen[cs]e(?: version [123])?(?: as published by the free software foundation)?
8 lgpl|under the lgpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the lgpl(?: version)?(?: v?[23](?: [01])?)?
8 lgpl|under the gnu lgpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the gnu lgpl(?: version)?(?: v?[23](?: [01])?)?
8 lgpl|gnu lesser general public|under (?:the )?terms of the gnu lesser general public licen[cs]e(?: version [23](?: [01])?)?
8 lgpl|gnu library general public|under (?:the )?terms of the gnu library general public licen[cs]e(?: version 2)?
8 lgpl|terms of the lgpl|under (?:the )?terms of the lgpl(?: version)?(?: v?[23](?: [01])?)?
8 agpl|under the agpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the agpl(?: version)?(?: v?[13](?: 0)?)?
8 agpl|under the gnu agpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the gnu agpl(?: version)?(?: v?3(?: 0)?)?
8 agpl|gnu affero general public|under (?:the )?terms of the gnu affero general public licen[cs]e(?: version 3)?
8 gfdl|free documentation license|under (?:the )?terms of the gnu free documentation license(?: version 1 [123])?
8 bsd|under the bsd|(?:released|distributed|available|provided|published|licen[cs]ed) under the bsd(?: licen[cs]e)?
8 bsd|clause bsd|(?:released|distributed|available|provided|published|licen[cs]ed) under the (?:two|three|four|2|3|4|new|simplified) clause bsd(?: licen[cs]e)?
8 bsd|bsd style|(?:released|distributed|available|licen[cs]ed) under a bsd style licen[cs]e
8 bsd|terms of the bsd|under (?:the )?terms of the bsd(?: licen[cs]e)?
8 isc|under the isc|(?:released|distributed|available|licen[cs]ed) under the isc(?: licen[cs]e)?
8 mpl|under the mpl|(?:released|distributed|available|provided|published|licen[cs]ed) under the mpl(?: version)?(?: [12] [01])?
8 mpl|terms of the mpl|under (?:the )?terms of the mpl(?: version)?(?: [12] [01])?
8 mpl|mozilla public license|subject to the (?:terms of the )?mozilla public license(?: version| v)? [12] [01]
8 mpl|terms of the mozilla public|under (?:the )?terms of the mozilla public license(?: version [12] [01])?
8 epl|eclipse public license|(?:made available|licen[cs]ed|distributed) under the (?:terms of the )?eclipse public license(?: v| version)?(?: [12] 0)?
8 epl|terms of the epl|under (?:the )?terms of the epl(?: [12] 0)?
8 edl|eclipse distribution license|(?:made available|licen[cs]ed|distributed) under the (?:terms of the )?eclipse distribution license(?: v| version)?(?: 1 0)?
8 cddl|development and distribution|(?:licen[cs]ed|distributed) under the common development and distribution license(?: version)?(?: 1 [01])?
8 cddl|terms of the cddl|under (?:the )?terms of the cddl(?: 1 [01])?
8 cc-by|creative commons attribution|(?:licen[cs]ed|released|available|published) under (?:a|the) creative commons attribution(?: licen[cs]e)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
8 cc-by-sa|creative commons attribution share|(?:licen[cs]ed|released|available|published) under (?:a|the) creative commons attribution share ?alike(?: licen[cs]e)?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
8 cc-by-nc|creative commons attribution non|(?:licen[cs]ed|released|available|published) under (?:a|the) creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1-4] [05])?
8 cc-by-nd|creative commons attribution no|(?:licen[cs]ed|released|available|published) under (?:a|the) creative commons attribution no ?deriv(?:s|atives)(?: licen[cs]e)?(?: [1-4] [05])?
8 cc0|under cc0|(?:released|licen[cs]ed|available|published) under cc0(?: 1 0)?
8 wtfpl|under the wtfpl|(?:released|licen[cs]ed|distributed) under the wtfpl
8 zlib|under the zlib|(?:released|licen[cs]ed|distributed) under the zlib(?: libpng)?(?: licen[cs]e)?
8 boost|boost software license|distributed under the boost software license(?: version 1 0)?
8 artistic|under the artistic|(?:released|licen[cs]ed|distributed) under the artistic license(?: [12] 0)?
8 artistic|same terms as perl|under the same terms as perl(?: itself)?
8 postgresql|under the postgresql|(?:released|licen[cs]ed|distributed) under the postgresql licen[cs]e
8 ofl|sil open font license|licen[cs]ed under the sil open font license(?: version 1 [01])?
8 eupl|under the eupl|licen[cs]ed under the eupl(?: version)?(?: 1 [012])?
8 osl|open software license|licen[cs]ed under the open software license(?: version)? [123] [01]
8 afl|academic free license|licen[cs]ed under the academic free license(?: version)? [123] [01]
8 ms-pl|microsoft public license|(?:released|licen[cs]ed|distributed) under the microsoft public license
8 ms-rl|microsoft reciprocal license|(?:released|licen[cs]ed|distributed) under the microsoft reciprocal license
8 sspl|server side public license|(?:released|licen[cs]ed|distributed) under the server side public license
8 elastic|under the elastic license|(?:released|licen[cs]ed|distributed) under the elastic license(?: 2 0)?
8 bsl|business source license|(?:released|licen[cs]ed|distributed) under the business source license(?: 1 1)?
8 mulan|under mulan|licen[cs]ed under mulan psl v[12]
8 unlicense|under the unlicense|(?:released|licen[cs]ed|distributed) under the unlicense
6 apache|apache org licenses|apache org licenses license [12] [01](?: txt| html)?
6 mit|opensource org licenses mit|opensource org licenses mit(?: license)?(?: php)?
6 bsd|opensource org licenses bsd|opensource org licenses bsd license(?: php)?
6 gpl|gnu org licenses gpl|gnu org licenses gpl(?: [123] 0)?(?: txt| html)?
6 lgpl|gnu org licenses lgpl|gnu org licenses lgpl(?: [23] [01])?(?: txt| html)?
6 agpl|gnu org licenses agpl|gnu org licenses agpl(?: 3 0)?(?: txt| html)?
6 gfdl|gnu org licenses fdl|gnu org licenses fdl(?: 1 [123])?(?: txt| html)?
6 mpl|mozilla org mpl|mozilla org mpl(?: mpl)?(?: [12] [01])?
6 epl|eclipse org legal epl|eclipse org legal epl (?:v10|v20|2 0)(?: html)?
6 cc-by|creativecommons org licenses by|creativecommons org licenses by [1-4] [05]
6 cc-by-sa|creativecommons org licenses by sa|creativecommons org licenses by sa [1-4] [05]
6 cc-by-nc|creativecommons org licenses by nc|creativecommons org licenses by nc(?: sa| nd)? [1-4] [05]
6 cc-by-nd|creativecommons org licenses by nd|creativecommons org licenses by nd [1-4] [05]
6 cc0|creativecommons org publicdomain zero|creativecommons org publicdomain zero 1 0
6 unlicense|unlicense org|unlicense org
6 boost|boost org license|boost org license 1 0 txt
6 ofl|scripts sil org ofl|scripts sil org ofl
6 wtfpl|wtfpl net|wtfpl net
5 apache|apache license|apache license version [12] [01]
5 apache|apache software license|apache software license(?: version)?(?: 1 [01])?
5 gpl|general public license|(?:gnu )?general public license (?:version|v) [123](?: 0)?(?: or (?:at your option )?any later version)?
5 gpl|gpl v|(?:gnu )?gpl v[123]
5 gpl|gplv|(?:gnu )?gplv[123]
5 gpl|gpl version|(?:gnu )?gpl version [123]
5 lgpl|lesser general public license|(?:gnu )?lesser general public license (?:version|v) [23](?: [01])?
5 lgpl|lgpl v|lgpl v[23]
5 lgpl|lgplv|lgplv[23]
5 agpl|affero general public license|(?:gnu )?affero general public license (?:version|v) [13](?: 0)?
5 agpl|agplv|agplv3
5 mpl|mozilla public license|mozilla public license (?:version|v) [12] [01]
5 epl|eclipse public license|eclipse public license (?:version|v)? ?[12] 0
5 cpl|common public license|common public license (?:version|v) 1 0
5 artistic|artistic license|artistic license (?:version )?[12] 0
5 boost|boost software license|boost software license version 1 0
5 python|python software foundation license|python software foundation license version 2
5 eupl|european union public licen|european union public licen[cs]e (?:version|v)? ?1 [012]
5 ofl|open font license|(?:sil )?open font license version 1 [01]
5 mulan|mulan permissive software license|mulan permissive software license(?: v| version )?[12]
4 mit|mit license|mit license
4 mit|mit licence|mit licence
4 expat|expat licen|expat licen[cs]e
4 x11|x11 licen|x11 licen[cs]e
4 apache|apache license|apache license
4 apache|apache 2|apache 2(?: 0)?(?: licen[cs]e)?
4 gpl|general public licen|(?:gnu )?general public licen[cs]e
4 gpl|gnu gpl|gnu gpl
4 gpl|gpl licen|gpl licen[cs]e
4 lgpl|lesser general public licen|(?:gnu )?lesser general public licen[cs]e
4 lgpl|library general public licen|(?:gnu )?library general public licen[cs]e
4 lgpl|lgpl licen|lgpl licen[cs]e
4 agpl|affero general public licen|(?:gnu )?affero general public licen[cs]e
4 agpl|agpl licen|agpl licen[cs]e
4 gfdl|free documentation licen|(?:gnu )?free documentation licen[cs]e
4 bsd|bsd licen|(?:(?:two|three|four|2|3|4) clause |new |modified |simplified |revised )?bsd licen[cs]e
4 isc|isc licen|isc licen[cs]e
4 isc|internet systems consortium licen|internet systems consortium licen[cs]e
4 mpl|mozilla public licen|mozilla public licen[cs]e
4 epl|eclipse public licen|eclipse public licen[cs]e
4 edl|eclipse distribution licen|eclipse distribution licen[cs]e
4 cddl|common development and distribution licen|common development and distribution licen[cs]e
4 cpl|common public licen|common public licen[cs]e
4 cc-by|creative commons attribution|creative commons attribution(?: licen[cs]e)?
4 cc-by-sa|creative commons attribution share|creative commons attribution share ?alike(?: licen[cs]e)?
4 cc-by-nc|creative commons attribution non|creative commons attribution non ?commercial(?: licen[cs]e)?
4 cc-by-nd|creative commons attribution no|creative commons attribution no ?deriv(?:s|atives|ative works)(?: licen[cs]e)?
4 cc0|creative commons zero|creative commons zero
4 cc0|cc0 licen|cc0 licen[cs]e
4 cc0|cc0 1 0|cc0 1 0
4 mit|mit open source licen|mit open source licen[cs]e
4 gpl|the gnu public licen|the gnu public licen[cs]e
4 bsd|bsd style licen|bsd style licen[cs]e
4 lgpl|gnu lgpl|gnu lgpl
4 agpl|gnu agpl|gnu agpl
4 python|psf licen|psf licen[cs]e
4 hpnd|historical permission notice and disclaimer|historical permission notice and disclaimer
4 beerware|beer ware licen|(?:the )?beer ware licen[cs]e
4 json|json licen|(?:the )?json licen[cs]e
4 sleepycat|sleepycat licen|sleepycat licen[cs]e
4 qpl|q public licen|(?:the )?q public licen[cs]e
4 curl|curl licen|(?:the )?curl licen[cs]e
4 unlicense|the unlicense|the unlicense
4 wtfpl|what the fuck you want to public licen|do what the fuck you want to public licen[cs]e
4 zlib|zlib licen|zlib licen[cs]e
4 zlib|zlib libpng licen|zlib libpng licen[cs]e
4 boost|boost software licen|boost software licen[cs]e
4 artistic|artistic licen|(?:perl )?artistic licen[cs]e
4 python|python software foundation licen|python software foundation licen[cs]e
4 php|php licen|php licen[cs]e
4 postgresql|postgresql licen|postgresql licen[cs]e
4 openssl|openssl licen|openssl licen[cs]e
4 openssl|ssleay licen|ssleay licen[cs]e
4 ofl|open font licen|(?:sil )?open font licen[cs]e
4 eupl|european union public licen|european union public licen[cs]e
4 cecill|cecill|cecill(?: [abc])?(?: licen[cs]e)?
4 odbl|open database licen|open database licen[cs]e
4 pddl|public domain dedication and licen|public domain dedication and licen[cs]e
4 osl|open software licen|open software licen[cs]e
4 afl|academic free licen|academic free licen[cs]e
4 ms-pl|microsoft public licen|microsoft public licen[cs]e
4 ms-rl|microsoft reciprocal licen|microsoft reciprocal licen[cs]e
4 ncsa|ncsa open source licen|(?:university of illinois )?ncsa open source licen[cs]e
4 unicode|unicode licen|unicode licen[cs]e
4 w3c|w3c software|w3c software(?: notice and)? licen[cs]e
4 vim|vim licen|vim licen[cs]e
4 ruby|ruby licen|ruby licen[cs]e
4 tex|latex project public licen|latex project public licen[cs]e
4 sspl|server side public licen|server side public licen[cs]e
4 elastic|elastic licen|elastic licen[cs]e
4 bsl|business source licen|business source licen[cs]e
3 mit|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy
3 mit|above copyright notice and this permission notice|the above copyright notice and this permission notice shall be included in all
3 mit|without warranty of any kind express or implied|provided as is without warranty of any kind express or implied
3 isc|for any purpose with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee
3 bsd|source and binary forms with or without modification|redistribution and use in source and binary forms with or without modification are permitted
3 bsd|redistributions of source code must retain|redistributions of source code must retain the above copyright notice
3 gpl|free software you can redistribute it|this (?:program|library) is free software you can redistribute it and or modify
3 gpl|useful but without any warranty|in the hope that it will be useful but without any warranty
3 unlicense|free and unencumbered software|this is free and unencumbered software released into the public domain
3 public-domain|the public domain|(?:released|placed|dedicated) (?:in|into|to) the public domain
3 boost|accompanying documentation covered by this license|obtaining a copy of the software and accompanying documentation covered by this license
3 zlib|altered source versions must be plainly marked|altered source versions must be plainly marked as such
3 proprietary|all rights reserved|all rights reserved
3 proprietary|proprietary and confidential|proprietary and confidential
3 proprietary|unauthorized copying of this file|unauthorized copying of this file(?: via any medium)? is strictly prohibited
"""

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOP = 9


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of all rules; patterns begin and end at a word's."""
    out = []
    for line in RULES_TEXT.strip().split("\n"):
        head, keyword, pattern = line.split("|", 2)
        priority, label = head.split(" ", 1)
        out.append((int(priority), label, keyword, f"(?<= )(?:{pattern})(?= )"))
    return out


def canonical(text: Column) -> Column:
    """Words in lower case between single spaces, with a space at either end; one space where there are none.

    Letters beyond ASCII are part of words either way, so lower case of all letters parts words as that of A-Z does, and no base phrase has a letter that another character is lowered to.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), WORD_BREAK, " ")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(text: Column, rule: Column) -> Column:
    """Intervals (start, stop) of all matches of a rule: what is between the matches, and they, add up."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    zipped = F.filter(F.arrays_zip(F.split(text, rule["pattern"]).alias("gap"), found.alias("hit")), lambda z: z["hit"].isNotNull())
    empty = F.array().cast("array<struct<start:int,stop:int,priority:int,label:string>>")
    step = lambda s, z: F.struct(
        (s["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + F.length(z["gap"])).alias("start"), (s["at"] + F.length(z["gap"]) + F.length(z["hit"])).alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label")))).alias("out"),
    )
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def _resolve(intervals: Column) -> Column:
    """Labels and best priority of intervals that no other suppresses.

    In order of start, longest first, an interval lies within an earlier one exactly if that one stops no sooner;
    so the furthest stop of each priority is all that must be known.
    """
    top = TOP
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["stop"] > b["stop"], -1).when(a["stop"] < b["stop"], 1).when(a["priority"] > b["priority"], -1).when(a["priority"] < b["priority"], 1).otherwise(0)
    zero = F.struct(F.array_repeat(F.lit(-1), top + 1).alias("far"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(s: Column, d: Column) -> Column:
        within = F.array_max(F.slice(s["far"], d["priority"] + 1, top + 1)) >= d["stop"]
        far = F.transform(s["far"], lambda x, i: F.when(i == d["priority"], F.greatest(x, d["stop"])).otherwise(x))
        return F.struct(
            far.alias("far"),
            F.when(within, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"]))).alias("labels"),
            F.when(within, s["best"]).otherwise(F.greatest(s["best"], d["priority"])).alias("best"),
        )

    # a lower priority suppresses nothing above it, but ties of one interval go to the higher
    return F.aggregate(F.array_sort(intervals, order), zero, step, lambda s: F.struct(s["labels"].alias("labels"), s["best"].alias("best")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    table = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern")) for p, label, k, x in rules()])
    base = "(?<= )(" + "|".join(p for p, _ in BASE) + ")(?= )"
    keywords = F.array(*map(F.lit, sorted({k for _, _, k, _ in rules()})))
    df = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    c = F.col("c")
    df = df.withColumn("told", F.filter(keywords, lambda k: F.contains(c, k)))
    none = F.array().cast("array<string>")
    has_base = F.contains(c, F.lit(" license "))
    df = df.select(
        "doc_id",
        F.greatest(_spaces(c) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(has_base, F.split(c, base)).otherwise(none).alias("gaps"),
        F.when(has_base, F.regexp_extract_all(c, F.lit(base), F.lit(1))).otherwise(none).alias("hits"),
        F.when(F.size("told") > 0, _resolve(F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(F.col("told"), r["keyword"])), lambda r: _spans(c, r))))).alias("found"),
    )
    n = F.size("hits")
    label = lambda h: F.when(h == BASE[0][0], BASE[0][1]).when(h == BASE[1][0], BASE[1][1]).otherwise(BASE[2][1])
    base_labels = F.array_distinct(F.transform("hits", label))
    last = F.col("n_words") - (_spaces(F.element_at("gaps", -1)) - 1) - (_spaces(F.element_at("hits", -1)) + 1)
    return df.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.when(n > 0, _spaces(F.element_at("gaps", 1)) - 1).cast("long").alias("first_word"),
        F.when(n > 0, last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("found.labels", none))), ",").alias("labels"),
        F.greatest(F.when(n > 0, 0.9).otherwise(0.0), F.coalesce(F.col("found.best"), F.lit(0)) / float(TOP)).alias("score"),
    )
