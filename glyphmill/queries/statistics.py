"""Statistics queries over lexicons drawn from the tables (binding T: shows scale and relational results, not domain data).

Words are part names (two tokens) or words of the English documents; codes are
formula codes of the tokens or the first letters of words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import codes as C
from glyphmill.functions.fixtures import Fixture
from glyphmill.operators import lexicon as L
from glyphmill.operators import stats as S
from glyphmill.sources.tables import parquet


def parts(spark, d):
    return L.lexicon_of_parts(parquet(spark, d, "part", ["p_partkey", "p_name"]), parquet(spark, d, "lineitem", ["l_partkey", "l_quantity"]))


def tokens(spark, d):
    return L.lexicon_of_tokens(parquet(spark, d, "documents", ["text", "lang"]))


def part_codes(spark, d, formula="AaBa"):
    return parts(spark, d).select("word", C.compose(formula, F.col("chars")).alias("code"), "freq", "ord")


def token_codes(spark, d, length=4):
    return tokens(spark, d).select("word", F.substring("word", 1, length).alias("code"), "freq")


PARTS = """p AS (
  SELECT p_name AS word, CAST(coalesce(sum(q), 0) AS DOUBLE) AS freq, min(p_partkey) AS ord
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1
), pc AS (
  SELECT word, substr(split_part(word, ' ', 1), 1, 1) || substr(split_part(word, ' ', 2), 1, 1) AS code, freq, ord FROM p
)"""
TOKENS = """t AS (
  SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') GROUP BY 1
), tc AS (SELECT word, substr(word, 1, 4) AS code, freq FROM t)"""
ALPHABET = "a AS (SELECT chr(CAST(k AS INTEGER)) AS key FROM range(97, 123) r(k))"
CUT = "unnest(string_split(code, ''))"


def lexicon_from_parts(spark, d):
    return parts(spark, d).select("word", F.size("chars").alias("n_chars"), "freq", "ord")


def compose_word_codes(spark, d):
    rules = [{"length_equal": 2, "formula": "AaBaAzBz"}, {"length_in_range": (3, 9), "formula": "AaBaCaZa"}]
    return parts(spark, d).select("word", C.compose_by_rules(rules, F.col("chars")).alias("code"))


def code_collisions(spark, d):
    return S.collisions(token_codes(spark, d)).select("code", "n", F.md5("words").alias("words_md5"))


def code_collisions_parts(spark, d):
    return S.collisions(part_codes(spark, d))


def collision_totals(spark, d):
    return S.collision_total(token_codes(spark, d))


def sequence_collisions(spark, d):
    keyed = token_codes(spark, d).select("word", C.masked_key(F.col("code"), [0, 2], 4).alias("code"))
    return keyed.groupBy("code").agg(F.count("*").alias("n"), F.min("word").alias("first_word")).where("n > 1")


def collision_estimate_all(spark, d):
    return S.collision_estimate(token_codes(spark, d), [0, 1, 2, 3], 4, 26)


def collision_estimate_some(spark, d):
    return S.collision_estimate(token_codes(spark, d), [0, 1, 3], 4, 26)


def code_rank(spark, d):
    return S.with_rank(token_codes(spark, d)).select("word", "code", "freq", "rank")


def freq_place(spark, d):
    return S.frequency_rank(tokens(spark, d)).select("word", "freq", "place")


def freq_tiers_duplication(spark, d):
    return S.tier_metrics(token_codes(spark, d), S.WORD_TIERS)


def top_words(spark, d):
    return S.top_by_frequency(tokens(spark, d), 100)


def short_codes(spark, d):
    return S.short_codes(token_codes(spark, d), [(1, 1), (2, 2), (3, 1)])


def key_distribution_count(spark, d):
    return S.unary_distribution(token_codes(spark, d), weighted=False)


def key_distribution_weighted(spark, d):
    return S.unary_distribution(token_codes(spark, d), weighted=True)


def key_distribution_binary(spark, d):
    return S.binary_distribution(token_codes(spark, d), 0, 1)


def fingering_bigrams(spark, d):
    return S.bigram_counts(token_codes(spark, d))


#: Equivalence by distance of the two keys in the alphabet, a stand-in for a measured table; pairs beyond 12 have none.
EQUIVALENCE = Fixture("seq string, value double", tuple((chr(97 + i) + chr(97 + j), 1.0 + abs(i - j) / 10) for i in range(26) for j in range(26) if abs(i - j) <= 12))


def pair_equivalence_histogram(spark, d):
    pairs = S.pair_counts(token_codes(spark, d), 0, 1).withColumnRenamed("pair", "seq")
    return pairs.join(F.broadcast(EQUIVALENCE.df(spark)), "seq", "left").groupBy(F.coalesce("value", F.lit(0.0)).alias("value")).agg(F.sum("n").alias("n"))


def keyboard_row_rollup(spark, d):
    return S.row_subtotals(S.unary_distribution(token_codes(spark, d), weighted=False))


def element_position_counts(spark, d):
    return S.element_positions(token_codes(spark, d), 4)


def collision_attribution(spark, d):
    rows = token_codes(spark, d, 2).select("word", "code", F.substring("word", 1, 4).alias("seq"))
    return S.collision_attribution(rows, 4)


def marginal_duplicates(spark, d):
    """Words that collide when only three letters are keyed and didn't with four."""
    t = tokens(spark, d)
    collide = lambda n: t.withColumn("code", F.substring("word", 1, n)).join(t.groupBy(F.substring("word", 1, n).alias("code")).agg(F.count("*").alias("n")).where("n > 1"), "code").select("word")
    return collide(3).exceptAll(collide(4)).select("word")


def _external(spark, d):
    """An external table: codes of most words, wrong where the order number divides by 5, none where by 7, two where by 3."""
    p = part_codes(spark, d)
    wrong = F.when(F.col("ord") % 5 == 0, F.concat(F.col("code"), F.lit("x"))).otherwise(F.col("code"))
    base = p.where(F.col("ord") % 7 != 0).select("word", wrong.alias("code"))
    return base.unionByName(p.where((F.col("ord") % 7 != 0) & (F.col("ord") % 3 == 0)).select("word", F.lit("zz").alias("code")))


EXTERNAL = """e AS (
  SELECT word, CASE WHEN ord % 5 = 0 THEN code || 'x' ELSE code END AS code FROM pc WHERE ord % 7 <> 0
  UNION ALL SELECT word, 'zz' FROM pc WHERE ord % 7 <> 0 AND ord % 3 = 0
), chk AS (
  SELECT pc.word, pc.code, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.word = pc.word) THEN 'unknown'
         WHEN EXISTS (SELECT 1 FROM e WHERE e.word = pc.word AND e.code = pc.code) THEN 'correct' ELSE 'incorrect' END AS verdict FROM pc
)"""


def proofread_forward(spark, d):
    return S.proofread(part_codes(spark, d), _external(spark, d))


def proofread_reverse(spark, d):
    return S.proofread(_external(spark, d), part_codes(spark, d))


def proofread_summary(spark, d):
    return S.proofread_summary(proofread_forward(spark, d))


def priority_short_code_join(spark, d):
    """Assembly rows joined with a list of priority short codes by identifier; others have none."""
    rows = parts(spark, d).select("word", C.identifier(F.col("word"), F.array(F.col("chars"), F.array(F.element_at("chars", 1)))).alias("id"), "ord")
    listed = rows.where(F.col("ord") % 4 == 0).select("id", F.concat(F.lit("s"), F.substring("word", 1, 1)).alias("short"))
    return rows.join(listed, "id", "left").select("word", "id", F.coalesce("short", F.lit("")).alias("short"))


def positional_zip(spark, d):
    """Assembly rows with the encoder's rows of the same order number; missing ones are empty with rank 0."""
    p = part_codes(spark, d)
    encoded = S.with_rank(p).where("ord % 6 <> 0").select("ord", F.col("code").alias("full"), F.col("rank").alias("full_rank"))
    return p.join(encoded, "ord", "left").select("ord", "word", F.coalesce("full", F.lit("")).alias("full"), F.coalesce("full_rank", F.lit(0)).alias("full_rank"))


def encoder_metrics(spark, d):
    """Long-form metrics of a code table by tier: code lengths, key shares and bigram repeats."""
    rows = S.frequency_rank(token_codes(spark, d))
    tiers = rows.withColumn("tier", F.explode(F.array(F.lit(500), F.lit(2000), F.lit(1 << 30)))).where("place <= tier")
    total = tiers.groupBy("tier").agg(F.sum("freq").alias("total"))
    levels = tiers.groupBy("tier", F.length("code").cast("string").alias("subtype")).agg(F.sum("freq").alias("w")).withColumn("type", F.lit("levels"))
    keys = tiers.select("tier", F.explode(F.split("code", "")).alias("subtype"), "freq").where("subtype <> ''").groupBy("tier", "subtype").agg(F.sum("freq").alias("w")).withColumn("type", F.lit("keys"))
    again = tiers.where("length(code) > 1 AND substring(code, 1, 1) = substring(code, 2, 1)").groupBy("tier").agg(F.sum("freq").alias("w")).select("tier", F.lit("same").alias("subtype"), "w", F.lit("fingering").alias("type"))
    return levels.unionByName(keys).unionByName(again).join(total, "tier").select("tier", "type", "subtype", F.round(F.col("w").cast("double") / F.col("total"), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_from_parts, compose_word_codes, code_collisions, code_collisions_parts, collision_totals, sequence_collisions, collision_estimate_all, collision_estimate_some, code_rank, freq_place,
        freq_tiers_duplication, top_words, short_codes, key_distribution_count, key_distribution_weighted, key_distribution_binary, fingering_bigrams, pair_equivalence_histogram, keyboard_row_rollup,
        element_position_counts, collision_attribution, marginal_duplicates, proofread_forward, proofread_reverse, proofread_summary, priority_short_code_join, positional_zip, encoder_metrics,
    )
}

_UNARY = f"k AS (SELECT {CUT} AS key, freq FROM tc)"
_COUNTS = "u AS (SELECT coalesce(a.key, x.key) AS key, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM a FULL JOIN (SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY 1) x ON a.key = x.key)"
_TIERS = "tiers AS (SELECT * FROM (VALUES (0, 2000), (1, 5000), (2, 10000), (3, 20000), (4, 40000), (5, 60000), (6, 4611686018427387904)) v(tier, top))"

SQL = {
    "lexicon_from_parts": f"WITH {PARTS} SELECT word, CAST(len(string_split(word, ' ')) AS INTEGER) AS n_chars, freq, ord FROM p",
    "compose_word_codes": f"""WITH {PARTS}, w AS (SELECT word, string_split(word, ' ') AS c FROM p)
        SELECT word, CASE WHEN len(c) = 2 THEN substr(c[1], 1, 1) || substr(c[2], 1, 1) || substr(c[1], -1, 1) || substr(c[2], -1, 1)
                          WHEN len(c) BETWEEN 3 AND 9 THEN substr(c[1], 1, 1) || substr(c[2], 1, 1) || substr(c[3], 1, 1) || substr(c[-1], 1, 1) END AS code FROM w""",
    "code_collisions": f"WITH {TOKENS} SELECT code, count(*) AS n, md5(string_agg(word, ' ' ORDER BY word)) AS words_md5 FROM tc GROUP BY 1 HAVING count(*) > 1",
    "code_collisions_parts": f"WITH {PARTS} SELECT code, count(*) AS n, string_agg(word, ' ' ORDER BY word) AS words FROM pc GROUP BY 1 HAVING count(*) > 1",
    "collision_totals": f"WITH {TOKENS} SELECT CAST(sum(n - 1) AS BIGINT) AS excess, max(n) AS largest, count(*) AS n_codes FROM (SELECT code, count(*) AS n FROM tc GROUP BY 1)",
    "sequence_collisions": f"""WITH {TOKENS} SELECT code, count(*) AS n, min(word) AS first_word FROM (
        SELECT word, substr(code, 1, 1) || ' * ' || CASE WHEN length(code) > 2 THEN substr(code, 3, 1) ELSE 'ε' END || ' *' AS code FROM tc) GROUP BY 1 HAVING count(*) > 1""",
    "collision_estimate_all": f"WITH {TOKENS} SELECT CAST(sum(n - 1) AS BIGINT) AS estimate FROM (SELECT code, count(*) AS n FROM tc GROUP BY 1)",
    "collision_estimate_some": f"""WITH {TOKENS} SELECT CAST(round(CAST(sum(n * n) AS DOUBLE) / 52.0) AS BIGINT) AS estimate FROM (
        SELECT substr(code, 1, 2), length(code) > 1, substr(code, 4, 1), count(*) AS n FROM tc GROUP BY 1, 2, 3)""",
    "code_rank": f"WITH {TOKENS} SELECT word, code, freq, CAST(row_number() OVER (PARTITION BY code ORDER BY freq DESC, word) - 1 AS INTEGER) AS rank FROM tc",
    "freq_place": f"WITH {TOKENS} SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) AS place FROM t",
    "freq_tiers_duplication": f"""WITH {TOKENS}, {_TIERS}, r AS (
        SELECT freq, row_number() OVER (PARTITION BY code ORDER BY freq DESC, word) AS rk, row_number() OVER (ORDER BY freq DESC, word) AS place FROM tc)
        SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, count(*) FILTER (rk > 1) AS duplication, round(CAST(coalesce(sum(freq) FILTER (rk > 1), 0) AS DOUBLE) / sum(freq), 6) AS duplication_share
        FROM r JOIN tiers ON place <= top GROUP BY 1""",
    "top_words": f"WITH {TOKENS} SELECT word, freq FROM t ORDER BY freq DESC, word LIMIT 100",
    "short_codes": f"""WITH {TOKENS},
        s1 AS (SELECT *, length(code) > 1 AND row_number() OVER (PARTITION BY substr(code, 1, 1), length(code) > 1 ORDER BY freq DESC, word) <= 1 AS got FROM tc),
        s2 AS (SELECT word, code, freq, length(code) > 2 AND row_number() OVER (PARTITION BY substr(code, 1, 2), length(code) > 2 ORDER BY freq DESC, word) <= 2 AS got FROM s1 WHERE NOT got),
        s3 AS (SELECT word, code, freq, length(code) > 3 AND row_number() OVER (PARTITION BY substr(code, 1, 3), length(code) > 3 ORDER BY freq DESC, word) <= 1 AS got FROM s2 WHERE NOT got)
        SELECT word, substr(code, 1, 1) AS short FROM s1 WHERE got UNION ALL SELECT word, substr(code, 1, 2) FROM s2 WHERE got
        UNION ALL SELECT word, CASE WHEN got THEN substr(code, 1, 3) ELSE code END FROM s3""",
    "key_distribution_count": f"WITH {TOKENS}, {ALPHABET}, {_UNARY}, {_COUNTS} SELECT key, value FROM u",
    "key_distribution_weighted": f"""WITH {TOKENS}, {ALPHABET}, {_UNARY}, x AS (SELECT key, CAST(sum(freq) AS DOUBLE) AS n FROM k WHERE key <> '' GROUP BY 1)
        SELECT coalesce(a.key, x.key) AS key, round(coalesce(n, 0) / (SELECT sum(n) FROM x), 6) AS value FROM a FULL JOIN x ON a.key = x.key""",
    "key_distribution_binary": f"""WITH {TOKENS}, {ALPHABET}, x AS (SELECT substr(code, 1, 2) AS pair, count(*) AS n FROM tc WHERE length(code) > 1 GROUP BY 1), sq AS (SELECT a.key || b.key AS pair FROM a, a b)
        SELECT coalesce(sq.pair, x.pair) AS pair, coalesce(n, 0) AS n FROM sq FULL JOIN x ON sq.pair = x.pair""",
    "fingering_bigrams": f"WITH {TOKENS} SELECT bigram, count(*) AS n, CAST(sum(freq) AS BIGINT) AS weight FROM (SELECT substr(code, CAST(i AS INTEGER), 2) AS bigram, freq FROM (SELECT code, freq, unnest(range(1, length(code))) AS i FROM tc)) GROUP BY 1",
    "pair_equivalence_histogram": f"""WITH {TOKENS}, q AS ({EQUIVALENCE.sql()}) SELECT coalesce(value, 0.0) AS value, count(*) AS n FROM tc LEFT JOIN q ON seq = substr(code, 1, 2) WHERE length(code) > 1 GROUP BY 1""",
    "keyboard_row_rollup": f"""WITH {TOKENS}, {ALPHABET}, {_UNARY}, {_COUNTS}, r AS (
        SELECT CASE WHEN contains('qwertyuiop', key) THEN 1 WHEN contains('asdfghjkl;', key) THEN 2 WHEN contains('zxcvbnm,./', key) THEN 3 ELSE 0 END AS row, key, value FROM u)
        SELECT CAST(coalesce(row, -1) AS INTEGER) AS row, coalesce(key, '*') AS key, sum(value) AS total FROM r GROUP BY ROLLUP (row, key)""",
    "element_position_counts": f"""WITH {TOKENS}, c AS (SELECT word, substr(code, CAST(i AS INTEGER), 1) AS element, i FROM (SELECT word, code, unnest(range(1, length(code) + 1)) AS i FROM tc))
        SELECT element, {", ".join(f"count(DISTINCT word) FILTER (i = {k + 1}) AS p{k}" for k in range(4))}, {" + ".join(f"count(DISTINCT word) FILTER (i = {k + 1})" for k in range(4))} AS total FROM c GROUP BY 1""",
    "collision_attribution": f"""WITH {TOKENS}, w AS (SELECT word, substr(word, 1, 2) AS code, substr(word, 1, 4) AS seq FROM t),
        d AS (SELECT substr(a.seq, CAST(i AS INTEGER), 1) AS x, substr(b.seq, CAST(i AS INTEGER), 1) AS y FROM w a JOIN w b ON a.code = b.code AND a.word < b.word, range(1, 5) r(i) WHERE length(a.seq) >= i AND length(b.seq) >= i)
        SELECT least(x, y) AS first, greatest(x, y) AS second, count(*) AS n FROM d WHERE x <> y GROUP BY 1, 2""",
    "marginal_duplicates": f"""WITH {TOKENS}, a AS (SELECT word, count(*) OVER (PARTITION BY substr(word, 1, 3)) AS n3, count(*) OVER (PARTITION BY substr(word, 1, 4)) AS n4 FROM t)
        SELECT word FROM a WHERE n3 > 1 AND n4 = 1""",
    "proofread_forward": f"WITH {PARTS}, {EXTERNAL} SELECT word, code, verdict FROM chk",
    "proofread_reverse": f"WITH {PARTS}, {EXTERNAL} SELECT e.word, e.code, CASE WHEN pc.word IS NULL THEN 'unknown' WHEN pc.code = e.code THEN 'correct' ELSE 'incorrect' END AS verdict FROM e LEFT JOIN pc ON pc.word = e.word",
    "proofread_summary": f"""WITH {PARTS}, {EXTERNAL} SELECT count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'unknown') AS unknown,
        CAST(round(100.0 * count(*) FILTER (verdict = 'correct') / count(*) FILTER (verdict <> 'unknown')) AS BIGINT) AS accuracy FROM chk""",
    "priority_short_code_join": f"WITH {PARTS} SELECT word, word || '-' || word || ',' || split_part(word, ' ', 1) AS id, CASE WHEN ord % 4 = 0 THEN 's' || substr(word, 1, 1) ELSE '' END AS short FROM p",
    "positional_zip": f"""WITH {PARTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY freq DESC, word) - 1 AS INTEGER) AS rk FROM pc)
        SELECT ord, word, CASE WHEN ord % 6 <> 0 THEN code ELSE '' END AS full, CASE WHEN ord % 6 <> 0 THEN rk ELSE 0 END AS full_rank FROM r""",
    "encoder_metrics": f"""WITH {TOKENS}, r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS place FROM tc), x AS (SELECT r.*, tier FROM r JOIN (VALUES (500), (2000), (1073741824)) v(tier) ON place <= tier),
        tot AS (SELECT tier, sum(freq) AS total FROM x GROUP BY 1), m AS (
        SELECT tier, 'levels' AS type, CAST(length(code) AS VARCHAR) AS subtype, sum(freq) AS w FROM x GROUP BY ALL
        UNION ALL SELECT tier, 'keys', key, sum(freq) FROM (SELECT tier, {CUT} AS key, freq FROM x) WHERE key <> '' GROUP BY ALL
        UNION ALL SELECT tier, 'fingering', 'same', sum(freq) FROM x WHERE length(code) > 1 AND substr(code, 1, 1) = substr(code, 2, 1) GROUP BY ALL)
        SELECT m.tier, type, subtype, round(CAST(w AS DOUBLE) / total, 6) AS share FROM m JOIN tot USING (tier)""",
}
