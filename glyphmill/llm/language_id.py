"""Operator 8: language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A document is
parsed greedily into the longest phrases that occur in that text; the language
that needs fewest phrases per symbol wins. Every letter that training saw is a symbol of its own, in
whatever script. Transitions over a language's commonest letters are dense tables
in which a missing transition already points to the state after the failed
symbol, marked by its sign; those over its other letters are sorted pairs of state and symbol. All segments of all
documents of a batch move on together, and a segment goes on in the state in which the one before it ends.

Training is a bounded sample, and its bounds are parameters: about ``sample_rows`` labelled rows per language, whole,
until ``train_symbols`` symbols per language are full, and ``model_symbols`` over all
languages (8000 a language at least), as automata are held by each worker. Prediction reads whole texts.

Cases: null text or text without a letter is ``und`` with score 0; letters that
training never saw are phrases of their own; ties go to the language that sorts
first; equal texts get equal results; repeated rows give a row each; with no labelled row every result is
``und``; other columns pass through untouched, and names of new ones are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import nullable, slices

SEGMENT = 128
#: Symbols: nothing, what is no letter, letters that training never saw; from ``LETTERS`` on, those it saw.
PAD, SPACE, OTHER, LETTERS = 0, 1, 2, 3
#: Letters of a language with columns in its dense table; all others are looked up by state and symbol.
DENSE = 60


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's text leaves 1 by 3; a null id is held out of neither (false)."""
    key = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(key.cast("binary")) % 3 == 1, F.lit(False))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence (state 0 is the root)."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(go)
        go.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def phrases(go: list[dict[int, int]], symbols: list[int]) -> int:
    """Greedy longest-match phrases of a sequence, one symbol at a time (the plain form, for tests).

    A symbol without a transition ends the phrase before it and opens the next, even from the root.
    """
    state, n = 0, 1
    for c in symbols:
        if c in go[state]:
            state = go[state][c]
        else:
            n += 1
            state = go[0].get(c, 0)
    return n


class Automaton:
    """Transitions of one language over its own alphabet: a dense table over the commonest letters, sorted pairs of state and symbol for the others."""

    def __init__(self, symbols: list[int], total: int):
        go = suffix_automaton(symbols)
        count = np.bincount([c for c in symbols if c >= 0], minlength=total)
        count[:LETTERS] = 0
        known = sorted(np.flatnonzero(count).tolist(), key=lambda c: -count[c])
        common, rare = known[:DENSE], known[DENSE:]
        self.width = LETTERS + len(common) + 1
        self.rare = self.width - 1
        self.local = np.full(total, OTHER, np.int32)  # a letter that the language doesn't have ends the phrase
        self.local[[PAD, SPACE]] = PAD, SPACE
        self.local[common] = LETTERS + np.arange(len(common), dtype=np.int32)
        self.local[rare] = self.rare
        self.root = np.zeros(total, np.int32)
        for c, t in go[0].items():
            if c >= 0:
                self.root[c] = t
        row = np.full(self.width, -1, np.int32)
        row[SPACE] = -1 - self.root[SPACE]
        row[LETTERS : self.rare] = -1 - self.root[common]
        step = np.tile(row, (len(go), 1))
        pairs = []
        for state, edges in enumerate(go):
            for c, t in edges.items():
                if c >= 0:
                    if self.local[c] == self.rare:
                        pairs.append((state << 32 | c, t))
                    else:
                        step[state, self.local[c]] = t
        step[:, PAD] = np.arange(len(go))
        self.step = step.ravel()
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.targets = np.array([t for _, t in pairs], np.int32)

    def move(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Next state of each; where the phrase ends, -1 - (the state that the symbol opens)."""
        local = self.local.take(symbols)
        out = self.step.take(state * self.width + local)
        if self.keys.size:
            at = np.flatnonzero(local == self.rare)
            if at.size:
                rare = symbols[at]
                wanted = state[at].astype(np.int64) << 32 | rare
                found = np.minimum(np.searchsorted(self.keys, wanted), self.keys.size - 1)
                out[at] = np.where(self.keys[found] == wanted, self.targets[found], -1 - self.root[rare])
        return out

    def ends(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that end in each segment (a column of ``columns``); one that ``follows`` goes on from the state in which the one before it ends.

        All segments are parsed from the root first. Then those that follow are parsed again from their true
        state, until they are in the state they were in before; where one never is, the next is parsed again.
        """
        depth, total = columns.shape
        states, ended = np.empty((depth, total), np.int32), np.empty((depth, total), bool)
        state = np.zeros(total, np.int32)
        for j in range(depth):
            to = self.move(state, columns[j])
            np.less(to, 0, out=ended[j])
            state = np.bitwise_xor(to, to >> 31, out=states[j])
        again = np.flatnonzero(follows)
        while again.size:
            now, state = again, states[-1, again - 1]
            for j in range(depth):
                to = self.move(state, columns[j, now])
                state = to ^ (to >> 31)
                moved = state != states[j, now]
                states[j, now], ended[j, now] = state, to < 0
                now, state = now[moved], state[moved]
                if not now.size:
                    break
            again = now[now + 1 < total] + 1
            again = again[follows[again]]
        return np.count_nonzero(ended, axis=0)


class Model:
    """Automata of all languages; every letter of the training texts is a symbol of its own."""

    def __init__(self, texts: dict[str, list[str]], train_symbols: int):
        self.langs = sorted(texts)
        chars = sorted({ch for ts in texts.values() for t in ts for ch in t.lower() if ch.isalpha()})
        self.table = np.fromiter((OTHER if chr(c).isalpha() else SPACE for c in range(0x110000)), np.int32, 0x110000)
        self.table[[ord(c) for c in chars]] = LETTERS + np.arange(len(chars), dtype=np.int32)
        self.automata = []
        for lang in self.langs:
            symbols: list[int] = []
            for t in texts[lang]:
                symbols += [*self.fold(t).tolist(), -1]
                if len(symbols) >= train_symbols:
                    break
            self.automata.append(Automaton(symbols[:train_symbols], LETTERS + len(chars)))

    def fold(self, text: str) -> np.ndarray:
        """Symbols of a text: letters in lower case, a space for each run of other characters, none at the ends."""
        codes = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        space = codes == SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        codes = codes[keep]
        return codes[:-1] if codes.size and codes[-1] == SPACE else codes

    def rates(self, folded: list[np.ndarray]) -> np.ndarray:
        """Phrases per symbol, for each text and language; nan for texts without symbols."""
        sizes = np.array([f.size for f in folded])
        segments = -(-sizes // SEGMENT)
        total = int(segments.sum())
        out = np.full((len(folded), len(self.langs)), np.nan)
        if not total:
            return out
        cells = np.zeros((total, SEGMENT), np.int32)
        starts = np.r_[0, np.cumsum(segments)]
        flat = cells.reshape(-1)
        for f, s in zip(folded, starts.tolist()):
            flat[s * SEGMENT : s * SEGMENT + f.size] = f
        columns = np.ascontiguousarray(cells.T)
        owner = np.repeat(np.arange(len(folded)), segments)
        follows = np.r_[False, owner[1:] == owner[:-1]]
        for k, automaton in enumerate(self.automata):
            ended = np.bincount(owner, automaton.ends(columns, follows), len(folded)) + 1  # and the phrase that the text ends in
            with np.errstate(invalid="ignore", divide="ignore"):
                out[:, k] = np.where(sizes > 0, ended / sizes, np.nan)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and symbols per phrase of each text.

        The score is one less the best rate over the second best (over 1 where there is one language only).
        """
        folded = [self.fold(t) if t else np.zeros(0, np.int32) for t in texts]
        empty = [not (f > SPACE).any() for f in folded]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rates = self.rates([np.zeros(0, np.int32) if e else f for e, f in zip(empty, folded)])
        langs, scores, spans = [], [], []
        for row, none in zip(rates, empty):
            if none:
                langs.append("und"), scores.append(0.0), spans.append(0.0)
                continue
            best = int(row.argmin())
            other = np.partition(row, 1)[1] if row.size > 1 else max(1.0, row[0])
            langs.append(self.langs[best])
            scores.append(float(min(1.0, max(0.0, 1 - row[best] / other))))
            spans.append(float(1 / row[best]))
        return langs, scores, spans


def train(docs: DataFrame, sample_rows: int = 200, train_symbols: int = 40_000, model_symbols: int = 800_000) -> Model:
    """Fit on the labelled rows that aren't held out; rows are chosen by a hash, so the sample doesn't depend on partitions.

    Whole texts are taken in the hash's order until the language has its symbols; only those reach the driver.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({}, train_symbols)
    symbols = min(train_symbols, max(8000, model_symbols // len(counts)))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1 << 30, (1 << 30) * sample_rows // n)))])
    rows = labelled.where(F.col("h") < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    earlier = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("text")).over(earlier), F.lit(0))).where(F.col("used") < symbols)
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(rows.select("lang", "h", F.substr("text", F.lit(1), (symbols - F.col("used")).cast("int")).alias("t")).collect(), key=lambda r: r["h"]):
        texts[r["lang"]].append(r["t"])
    return Model({k: v for k, v in texts.items() if v}, symbols)


def identify(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score", span_col: str = "phrase_len") -> DataFrame:
    """``docs`` with the predicted language, its score and the mean phrase length."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for rows in slices(batches, 1024):
            langs, scores, spans = m.predict(rows.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs), pa.array(scores, pa.float64()), pa.array(spans, pa.float64())], names=[*rows.schema.names, lang_col, score_col, span_col])

    return docs.mapInArrow(run, nullable(docs.withColumns({lang_col: F.lit(""), score_col: F.lit(0.0), span_col: F.lit(0.0)}).schema))


def keep_languages(docs: DataFrame, model: Model, min_phrase: float = 1.5) -> DataFrame:
    """Rows with a language: those without a letter go, and those whose phrases are so short that no learned language covers them."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for rows in slices(batches, 1024):
            langs, _, spans = m.predict(rows.column(at).to_pylist())
            yield rows.filter(pa.array([lang != "und" and span >= min_phrase for lang, span in zip(langs, spans)]))

    return docs.mapInArrow(run, nullable(docs.schema))
