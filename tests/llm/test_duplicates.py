"""Operators 5, 6 and 10 against brute force."""

import os
import random
import re

import duckdb
import numpy as np
import pytest

from glyphmill.llm import common, decontaminate, line_dedup, near_dedup, queries
from tests.llm.helpers import ODD, SF, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op5_decontaminate", "op6_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    want = oracle(name)
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute_hits(text, items, window=10):
    words = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        ws = WORD.findall(lower(t or ""))
        m = min(window, len(ws))
        wins = {tuple(ws[k : k + m]) for k in range(len(ws) - m + 1)} if m else set()
        for k in range(len(words) - m + 1):
            if m and tuple(words[k : k + m]) in wins:
                hit.update(range(k, k + m))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice("a b c d é9 ff".split()) for _ in range(n))
    items = [(k, text(pick.choice([1, 2, 5, 9, 10, 11, 14]))) for k in range(12)] + [(90, None), (91, "!!"), (92, "x1, X2! x3"), (92, "other words here")]
    rows = [(k, text(pick.choice([0, 3, 30, 80]))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)] + [(200, "so X1 x2 (x3) it"), (200, "so X1 x2 (x3) it"), (None, "x1 x2 x3")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, rows).withColumnRenamed("source", "n_hit")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((str(r.row.doc_id), r.n_words, r.n_hit, list(r.items)) for r in got) == sorted((str(k), *brute_hits(t, items)) for k, t in rows)
    assert decontaminate.decontaminate(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def brute_components(rows, width, percent):
    sets = {}
    for k, (_, t) in enumerate(rows):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if w]
        sets[k] = frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    out = []
    for k, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in sets if root(j) == root(k) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(key), len(sets[k]), str(least), key == least))
    return sorted(out)


def near_rows(seed=3):
    pick = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [pick.choice(vocab) for _ in range(pick.choice([3, 20, 60, 150]))]
        for _ in range(pick.choice([1, 2, 6])):
            ws = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                ws[pick.randrange(len(ws))] = pick.choice(vocab)
            rows.append((n * 7 % 1000, pick.choice([" ", "\n", "  "]).join(ws)))
            n += 1
    return rows + [(2000 + k, t) for k, t in enumerate(ODD)] + [(5, "same row again"), (5, "same row again"), (None, rows[0][1]), (3000, "Two words"), (3001, "two\tWORDS")]


@pytest.mark.parametrize("options", [{}, {"leaf": 3, "levels": 2, "group_docs": 3}, {"leaf": 4, "levels": 4}])
def test_near_duplicates_equal_brute_force(spark, options):
    rows = near_rows()
    docs = documents(spark, rows).withColumnRenamed("source", "kept")
    got = near_dedup.near_duplicates(docs, width=4, percent=80, **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_components(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [(1, "a b c")]).limit(0)).count() == 0
    assert [r.kept for r in near_dedup.near_duplicates(documents(spark, [(1, None), (2, None), (3, "")])).collect()] == [True] * 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        other = np.unique(np.r_[base[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)])
        same = np.count_nonzero(near_dedup.signature(base) == near_dedup.signature(other)) / near_dedup.COORDINATES
        assert abs(same - n / (4000 - n)) < 0.2


def test_components_equal_union_find(spark):
    pick = random.Random(9)
    pairs = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(up)}
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "test").collect()}
    alone = {x for x in want if want[x] == x and list(want.values()).count(x) == 1}
    assert got == {x: r for x, r in want.items() if x not in alone}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_equal_the_plain_one():
    pick = random.Random(2)
    pairs, most, want = [], [], []
    for _ in range(800):
        a = "".join(pick.choice("abc世") for _ in range(pick.randrange(20)))
        b = a if pick.random() < 0.1 else "".join(c for c in a if pick.random() < 0.8) + "".join(pick.choice("abc") for _ in range(pick.randrange(6)))
        pairs.append((line_dedup.code_points(a), line_dedup.code_points(b)))
        most.append(pick.randrange(12))
        d = plain_distance(a, b)
        want.append(d <= most[-1])
        got = line_dedup.bit_vector_distance(*pairs[-1], most[-1])
        assert got == d if d <= most[-1] else got > most[-1]
    assert line_dedup.within(pairs, np.array(most)).tolist() == want
    assert line_dedup._within(pairs, np.array(most)).tolist() == want
    long = "".join(pick.choice("abcdefg ") for _ in range(900))
    far = line_dedup.code_points(long[:300] + "x" + long[310:700] + "yz" + long[700:])
    d = plain_distance(long, "".join(map(chr, far)))
    assert [bool(line_dedup._within([(line_dedup.code_points(long), far)], np.array([k]))[0]) for k in (d - 1, d, d + 1)] == [False, True, True]


def test_lines_are_normalised_as_one_by_one():
    texts = ["One, TWO!\n\n  three\t\r\n...\nétÉ 世界。x ", None, "", "\n", "last", " a  b "]
    lines = line_dedup.Lines(texts)
    want = []
    for k, t in enumerate(texts):
        for n, x in enumerate(t.split("\n") if t else []):
            words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x.lower())
            if words:
                want.append((k, n, " ".join(words)))
    assert [(o, n, lines.line(i).decode()) for i, (o, n) in enumerate(zip(lines.owner.tolist(), lines.number.tolist()))] == want
    assert lines.sizes().tolist() == [len(w) for _, _, w in want]
    assert len(line_dedup.Lines([])) == len(line_dedup.Lines([None, "..."])) == 0


def some_lines(pick, sizes):
    vocab = ["".join(pick.choice("aeioulmnrst") for _ in range(pick.randrange(2, 9))) for _ in range(400)]
    return [" ".join(pick.choice(vocab) for _ in range(n)) for n in sizes]


def test_simhash_counts_bits():
    pick = random.Random(1)
    lines = some_lines(pick, [2, 3, 40, 60, 70, 300, 2000])
    made = line_dedup.Lines(["\n".join(lines)])
    got = line_dedup.simhashes(made.bytes, made.start, made.stop).view(np.uint64)
    for line, h in zip(lines, got):
        x = line_dedup._windows(np.frombuffer(line.encode(), np.uint8), 4)[: len(line) - 3]
        votes = [2 * int(((x >> np.uint64(8 * byte + bit)) & np.uint64(1)).sum()) > len(x) for bit in range(8) for byte in range(8)]
        assert int(h).bit_count() == sum(votes)
        assert line_dedup.simhashes(np.frombuffer(line.encode(), np.uint8), np.array([0]), np.array([len(line)])).view(np.uint64)[0] == h


def test_block_keys_do_not_depend_on_other_lines():
    pick = random.Random(3)
    lines = ["".join(pick.choice("abc de") for _ in range(n - 2)).join("xy") for n in (10, 15, 16, 23, 24, 39, 40, 300)]
    lines = [" ".join(x.split()) for x in lines]
    made = line_dedup.Lines(["\n".join(lines)])
    who, keys = line_dedup.block_keys(made.bytes, made.start, made.stop)
    for k, line in enumerate(lines):
        alone = np.frombuffer(line.encode(), np.uint8)
        assert sorted(keys[who == k]) == sorted(line_dedup.block_keys(alone, np.array([0]), np.array([len(line)]))[1])


def edited(pick, line, edits):
    for _ in range(edits):
        at, kind = pick.randrange(len(line)), pick.randrange(3)
        line = line[:at] + (pick.choice("abcdefghinorst") if kind < 2 else "") + line[at + (kind != 1) :]
    return " ".join(line.split())


def test_recall_of_pairs_alike_in_edits():
    """Of pairs that plain edit distance finds alike, those that meet in a block and pass the SimHash; without edits of other lines."""
    pick = random.Random(7)
    lines = some_lines(pick, [n for n in (3, 5, 8, 12, 20, 40, 60) for _ in range(60)])
    swapped = lambda x: " ".join("qu" + w if k == len(x.split()) // 2 else w for k, w in enumerate(x.split()))
    kinds = {"a letter": (lambda x: edited(pick, x, 1), 0.95), "a word": (swapped, 0.97), "up to 10 %": (lambda x: edited(pick, x, pick.randint(1, max(1, len(x) // 10))), 0.88)}
    for name, (change, least) in kinds.items():
        pairs = [(x, y) for x, y in ((x, change(x)) for x in lines) if x != y and 10 * plain_distance(x, y) <= max(len(x), len(y))]
        made = line_dedup.Lines([x for p in pairs for x in p])
        who, keys = line_dedup.block_keys(made.bytes, made.start, made.stop)
        sets = [set() for _ in range(len(made))]
        for k, key in zip(who.tolist(), keys.tolist()):
            sets[k].add(key)
        sim, size = line_dedup.simhashes(made.bytes, made.start, made.stop), made.sizes()
        fit = line_dedup.fits(size[::2], size[1::2], sim[::2], sim[1::2], 90)
        met = [bool(sets[2 * k] & sets[2 * k + 1]) and bool(fit[k]) for k in range(len(pairs))]
        assert len(pairs) > 200 and sum(met) >= least * len(met), (name, sum(met) / len(met))


def brute_lines(rows, percent=90):
    """Lines that go, with links between all lines that plain edit distance finds alike."""
    first, occ = {}, []
    for key, text in rows:
        for n, line in enumerate(text.split("\n") if text else []):
            h = " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", line.lower()))
            if h:
                at = (key is None, key if key is not None else text, n)
                first[h] = min(first.get(h, at), at)
                occ.append((at, h))
    names, up = list(first), {h: h for h in first}

    def root(h):
        while up[h] != h:
            h = up[h]
        return h

    for i, a in enumerate(names):
        for b in names[:i]:
            most = max(len(a), len(b))
            if abs(len(a) - len(b)) * 10 <= most and root(a) != root(b) and 10 * plain_distance(a, b) <= most:
                up[root(a)] = root(b)
    keep = {}
    for h in names:
        keep[root(h)] = min(keep.get(root(h), first[h]), first[h])
    return {at for at, h in occ if at != keep[root(h)]}


@pytest.mark.parametrize("options", [{}, {"group_lines": 4}, {"group_bytes": 900}])
def test_line_dedup_equals_brute_force(spark, options):
    pick = random.Random(8)
    lines = some_lines(pick, [pick.choice([1, 2, 16, 30]) for _ in range(24)]) + ["世界の人々は皆、同じ空の下に生きている", "}", "Yes."]

    def vary(line):
        x = pick.random()
        line = line + pick.choice(["!", " ", "..."]) if x < 0.3 else edited(pick, line, 1) if x < 0.5 and len(line) > 60 else line
        return line.upper() if pick.random() < 0.2 else line

    rows = [(k, "\n".join(vary(pick.choice(lines)) for _ in range(pick.randrange(6)))) for k in range(45)]
    rows += [(500 + k, t) for k, t in enumerate(ODD)] + [(None, lines[1] + "\nentirely new words stand in here"), (None, None)]
    rows = [r for r in rows if not r[1] or len(r[1]) < 3000]
    gone = brute_lines(rows)
    docs = documents(spark, rows).withColumnRenamed("source", "_gone")
    got = line_dedup.cleaned(docs, line_dedup.removals(docs, **options)).collect()
    want = []
    for key, text in rows:
        kept = [x for n, x in enumerate(text.split("\n")) if (key is None, key if key is not None else text, n) not in gone] if text is not None else None
        want.append((str(key), None if kept is None else "\n".join(kept), 0 if text is None else len(text.split("\n")) - len(kept)))
    assert len(gone) > 60
    assert sorted(((str(r.row.doc_id), r.row.text, r.n_removed) for r in got), key=str) == sorted(want, key=str)


def test_line_dedup_cases(spark):
    rows = [(1, "Thing.\nthe first line of some length here"), (2, "Thing.\na second line that differs from others"), (3, "thing\nThe FIRST line, of some length here!"), (4, None), (5, "...\n"), (6, "x\nx\ny"), (7, "same"), (7, "same"), (None, "same"), (None, "other")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(documents(spark, rows)).collect())
    want = [("1", rows[0][1]), ("2", "a second line that differs from others"), ("4", None), ("5", "...\n"), ("6", "x\ny"), ("7", "same"), ("7", "same"), ("None", "other")]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_report(documents(spark, rows).limit(0)).count() == 0


def test_frequent_lines_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 4)
    rows = [(k, "the same line in all of them\n" + " ".join(random.Random(k).choices(["ab", "cde", "fghi", "jk", "lmnop", "qrs", "tuv"], k=14))) for k in range(30)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_report(documents(spark, rows)).collect()}
    assert got == {k: int(k > 0) for k in range(30)}


def test_fine_trigrams_never_reject_what_is_near():
    pick = random.Random(12)
    pairs, most = [], []
    for _ in range(300):
        x = [pick.choice("abcd é世") for _ in range(pick.choice([10, 40, 300]))]
        y = list(x)
        for _ in range(pick.randrange(1 + len(x) // 5)):
            at = pick.randrange(len(y))
            y[at : at + pick.randrange(2)] = pick.choice([[], ["z"], ["a"]])
            y = y or ["a"]
        a, b = (line_dedup.code_points("".join(v)) for v in (x, y))
        pairs.append((a, b)), most.append(max(len(a), len(b)) // 10)
    most = np.array(most)
    near = line_dedup.within(pairs, most)
    assert near.any() and not near.all() and not (near & ~line_dedup.may_be_within(pairs, most)).any()


@pytest.mark.parametrize("banded", [8, 1])
def test_large_groups_of_lines_grow_in_proportion_by_bands(spark, monkeypatch, banded):
    monkeypatch.setattr(line_dedup, "BANDED", banded, raising=False)
    pick = random.Random(3)
    size = [pick.choice([10, 90, 99, 100, 110, 111, 900, 1000]) + pick.randrange(200) for _ in range(400)]
    met = spark.createDataFrame([(7, 7, k, n, 0, True) for k, n in enumerate(size)] + [(8, 1, 1, 10, 0, False), (8, 1, 2, 10, 0, False)], "node bigint, least bigint, id bigint, size int, sim bigint, hot boolean")
    at = {}
    for r in line_dedup.dealt_nodes(met, 90, group_lines=40, group_bytes=1 << 20).collect():
        at.setdefault(r.id, set()).add(r.node)
    assert 8 in at[1] and 8 in at[2]
    for a, n in enumerate(size):
        for b, m in enumerate(size[:a]):
            assert 10 * min(n, m) < 9 * max(n, m) or at[a] & at[b]
    assert sum(map(len, at.values())) <= (2 * len(size) + 2 if banded == 8 else 20 * len(size))


def test_letters_of_lines_never_reject_what_is_near():
    pick = random.Random(13)
    texts, near = [], []
    for _ in range(300):
        x = "".join(pick.choice("abcdefgh 09é世界") for _ in range(pick.choice([10, 40, 300, 3000]))).strip() or "a"
        y = edited(pick, x, pick.randint(1, 1 + len(x) // 8)).strip() or "b"
        made = line_dedup.Lines([x, y])
        if len(made) == 2:
            a, b = (line_dedup.code_points(made.line(k).decode()) for k in (0, 1))
            texts += [x, y]
            near.append(bool(line_dedup.within([(a, b)], np.array([max(len(a), len(b)) // 10]))[0]))
    made = line_dedup.Lines(texts)
    letters, size = line_dedup.letter_counts(made.bytes, made.start, made.stop), made.sizes()
    for k in range(0, len(made), 37):
        want = np.bincount([c.encode()[-1] & 31 for c in made.line(k).decode()], minlength=32)
        assert (letters[k] == want % 256).all()
    may = line_dedup.near_letters(letters[::2], letters[1::2], size[::2], size[1::2], 90)
    assert any(near) and not all(near) and not (np.array(near) & ~may).any() and not may.all()


def test_lines_that_meet_by_chance_are_no_nodes(spark):
    pick = random.Random(14)
    texts = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) + "x" for _ in range(90)]
    alike = texts[7][:60] + "q" + texts[7][61:]
    for some, blocks in ((texts, set()), ([*texts, alike], {7, 90})):  # one group, large and small
        made = line_dedup.Lines(some)
        letters, size = line_dedup.letter_counts(made.bytes, made.start, made.stop), made.sizes()
        rows = [(key, k, int(size[k]), 0, bytearray(letters[k].tobytes())) for key, n in ((1, len(some)), (2, 3)) for k in range(len(some) - n, len(some))]
        rows += [(3, k, int(size[k]), 0, bytearray(letters[k].tobytes())) for k in sorted(blocks)]
        keyed = spark.createDataFrame(rows, "key bigint, id bigint, size int, sim bigint, letters binary")
        met = {r.id for r in line_dedup.meetings(keyed, 90, 2000, 8 << 20).collect()}
        assert blocks <= met and len(met) < 10


def test_tables_are_saved_without_checksum_files(spark):
    saved = common.save(spark.range(50).repartition(3), "test-plain")
    files = os.listdir(saved._saved_path.removeprefix("file://").removeprefix("file:"))
    assert saved.count() == 50 and any(f.endswith(".parquet") for f in files) and not any(f.endswith(".crc") for f in files)


def test_pairs_are_verified_side_by_side(monkeypatch):
    pick = random.Random(15)
    words = ["".join(pick.choice("abcdeé世") for _ in range(pick.randrange(1, 8))) for _ in range(60)]
    pairs, most = [], []
    for _ in range(400):
        x = [pick.choice(words) for _ in range(pick.choice([1, 3, 12, 30]))]
        y = [w for w in x if pick.random() < 0.95]
        for _ in range(pick.randrange(4)):
            y.insert(pick.randrange(len(y) + 1), pick.choice(words))
        pairs.append((" ".join(x), " ".join(y))), most.append(pick.randrange(30))
    pairs += [("", ""), ("", "ab"), ("ab", ""), ("a b", "b a"), ("x" * 700, "x" * 300 + "y" * 400), ("x" * 700, "y" + "x" * 700)]
    most += [0, 1, 2, 2, 400, 1]
    want = [plain_distance(a, b) <= m for (a, b), m in zip(pairs, most)]
    said = [line_dedup.aligned(a, b, m) for (a, b), m in zip(pairs, most)]
    assert all(w for w, s in zip(want, said) if s) and sum(said) > 0.5 * sum(want) and not all(want)
    points = [tuple(map(line_dedup.code_points, p)) for p in pairs]
    monkeypatch.setattr(line_dedup, "bit_vector_distance", None)  # none is verified alone
    assert line_dedup._banded(points, np.array(most)).tolist() == want


def test_keys_are_dealt_out_many_in_a_row(spark, monkeypatch):
    pick = random.Random(16)
    rows = [(k, 100 + k % 7, pick.getrandbits(60), bytearray(32), bytearray(np.array([pick.randrange(40) for _ in range(12)], "<i8").tobytes())) for k in range(500)]
    lines = spark.createDataFrame(rows, "id bigint, size int, sim bigint, letters binary, keys binary").repartition(2)
    kind = line_dedup._KEYED
    got = [(r.bucket, x) for turn in range(3) for r in line_dedup.dealt_keys(lines, 3, turn, 4).collect() for x in np.frombuffer(r.rows, kind)]
    assert sum(line_dedup.dealt_keys(lines, 3, turn, 4).count() for turn in range(3)) <= 3 * 2 * 4
    assert sorted((int(x["id"]), int(x["key"]), int(x["size"]), int(x["sim"])) for _, x in got) == sorted((k, int(key), n, s) for k, n, s, _, keys in rows for key in np.frombuffer(bytes(keys), "<i8"))
    assert len({(b, int(x["key"])) for b, x in got}) == 40
    monkeypatch.setattr(line_dedup, "BUCKET_KEYS", 20)  # large groups are passed on before a bucket is whole
    met = line_dedup.meetings(lines.withColumn("sim", lines.id * 0), 90, 130, 8 << 20, buckets=4).collect()
    of = {}
    for k, *_, keys in rows:
        for key in np.frombuffer(bytes(keys), "<i8").tolist():
            of.setdefault(key, set()).add(k)
    hot = {}
    for r in met:
        if r.hot:
            hot.setdefault(r.node, set()).add(r.id)
    assert hot == {key: ids for key, ids in of.items() if len(ids) > 130} and 0 < len(hot) < 40
    assert {r.id for r in met if not r.hot} == set().union(*(ids for key, ids in of.items() if key not in hot))


def test_large_groups_are_parted_by_what_may_be_alike(spark):
    pick = random.Random(17)
    texts = ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) + "x" for _ in range(300)]
    pairs = {(k, 300 + k // 50) for k in range(7, 300, 50)}
    texts += [texts[a][:60] + "q" + texts[a][61:] for a, _ in sorted(pairs)]
    made = line_dedup.Lines(texts)
    letters, size = line_dedup.letter_counts(made.bytes, made.start, made.stop), made.sizes()
    rows = [(key, k, int(size[k]), 0, bytearray(letters[k].tobytes())) for key in (1, 2) for k in range(len(texts))]
    keyed = spark.createDataFrame(rows, "key bigint, id bigint, size int, sim bigint, letters binary")
    seen = []
    for group_lines in (2000, 40, 10):  # one group, bands of length, block against block
        met = line_dedup.meetings(keyed, 90, group_lines, 8 << 20)
        assert {r.hot for r in met.collect()} == {group_lines < 2000}
        nodes = {}
        for r in line_dedup.dealt_nodes(met, 90, group_lines, 8 << 20).collect():
            nodes.setdefault((r.node, r.least), []).append(r.id)
        assert pairs <= {tuple(sorted(x)) for x in nodes.values()}  # pairs are nodes of their own, in one group or in several
        seen.append(sum(map(len, nodes.values())))
    assert max(seen) < 40


def test_long_bands_of_few_and_many_pairs():
    pick = random.Random(18)
    pairs, most = [], []
    for n, many in ((90, 40), (1500, 3), (1500, 24)):
        for _ in range(many):
            x = "".join(pick.choice("abcdefgh é") for _ in range(n))
            y = edited(pick, x, pick.randint(1, n // 8))
            pairs.append((line_dedup.code_points(x), line_dedup.code_points(y)))
            distance = plain_distance(x, y) if n < 100 else line_dedup.bit_vector_distance(*pairs[-1], 2 * n)
            most.append(distance - len(most) % 2 if len(most) % 3 else n // 10)
    want = [line_dedup.bit_vector_distance(x, y, m) <= m for (x, y), m in zip(pairs, most)]
    assert line_dedup.within(pairs, np.array(most)).tolist() == want == line_dedup._banded(pairs, np.array(most)).tolist()
    assert any(want) and not all(want)
