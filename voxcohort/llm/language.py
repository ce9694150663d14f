"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily: each phrase is the longest
string that the language's text has. The language needing the fewest phrases, normalised by the logarithm of its text's
length, wins.

A text is parsed whole, in pieces of PIECE symbols side by side: each piece is first parsed as if a phrase began with it,
and parsed again from where the piece before it really ends until the two parses meet, which is within a few phrases.
What still differs after SWEEPS such rounds is parsed in order. Phrases are those of one parse from start to end.

The model is fitted on a bounded sample: at most `docs_per_language` training documents for each label, drawn by hash,
the first `chars_per_doc` symbols of each, and less where many labels share `model_cells` cells of transitions.

Symbols: letters, lower-cased; runs of anything else are one separator. The ALPHABET most frequent letters of the sample
have a symbol each, its others are spelled with two or three, so all are told apart; letters that no sample has match
nothing.
score: (second - best) / second of normalised phrases, 0 where the best two tie, 1 where only one language is learned.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if nothing was learned; ties
go to the label that sorts first; a label is learned from all of its texts that have a letter, and one whose sample is
less than half of the longest counts phrases as the longest does, so that few symbols are no advantage; null labels and
null doc_ids are not learned from; an empty table gives an empty table; other columns pass through, those named like the
results are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, keep_only, small_batches

PIECE, ALPHABET, SWEEPS = 128, 120, 4
#: Pieces times languages that are parsed side by side, unless one text has more.
GRID = 1 << 15
GAP, PAD, OTHER, FIRST = 0, 1, 2, 3
UNDEFINED = "und"
#: Tasks that gather counts and samples, few rows for each label, whatever the number of shuffle partitions.
GATHERED = 16


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of the text's symbols, runs of GAP collapsed, none at the ends."""
    found = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = found == GAP
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    found = found[keep]
    return found[(1 if len(found) and found[0] == GAP else 0) : len(found) - (1 if len(found) and found[-1] == GAP else 0)]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`, by state; state 0 is the root."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Model:
    """Transitions of all languages' automata, one after the other. Their table is made where it is first used and is not
    pickled, so that the driver holds and sends the transitions only."""

    def __init__(self, samples: dict[str, list[str]], chars_per_doc: int, model_cells: int):
        own, is_letter = sorted(samples), letters()
        counts = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        alphabet, rare = alphabet[:ALPHABET], sorted(alphabet[ALPHABET:])
        self.places = 2 if len(rare) <= 64**2 else 3
        self.base = next(b for b in range(65) if b**self.places >= len(rare))
        self.lead = FIRST + len(alphabet)
        self.width = self.lead + 2 * self.base
        self.classes = np.where(is_letter, OTHER, GAP).astype(np.int32 if rare else np.uint8)
        for i, c in enumerate(alphabet):
            self.classes[ord(c)] = FIRST + i
        for i, c in enumerate(rare):
            self.classes[ord(c)] = self.width + i
        most = max(1, model_cells // max(1, 2 * self.width * len(own)))  # an automaton has under 2 states a symbol
        self.languages, self.roots, sizes, cells, moves, at = own, [], [], [], [], 0
        for name in own:
            parts = [np.append(self.spelled(symbols(t, self.classes)[:chars_per_doc]), GAP) for t in samples[name]]
            text = np.concatenate(parts)[:most] if parts else np.zeros(0, np.uint8)
            go = automaton(text)
            n = sum(map(len, go))
            cells.append(np.fromiter((state * self.width + c for state, steps in enumerate(go, at) for c in steps), np.int64, n).astype(np.int32))
            moves.append(np.fromiter((to + at for steps in go for to in steps.values()), np.int32, n))
            self.roots.append(at)
            sizes.append(len(text))
            at += len(go)
        self.scale = [math.log2((n if 2 * n >= max(sizes) else max(sizes)) + 2) for n in sizes]
        self.states = at
        self.cells, self.moves = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (cells, moves))

    @cached_property
    def table(self) -> np.ndarray:
        """For each state and symbol the state after it, or -1."""
        table = np.full((self.states, self.width), -1, dtype=np.int32)
        table.ravel()[self.cells] = self.moves
        table[:, OTHER] = -1
        table[:, PAD] = np.arange(self.states)
        return table.ravel()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def spelled(self, found: np.ndarray) -> np.ndarray:
        """`found` with each rare letter as digits of its number, the first of them from symbols of its own."""
        rare = found >= self.width
        if not rare.any():
            return found
        n = np.where(rare, self.places, 1)
        out, number, start = np.repeat(found, n), found[rare] - self.width, (np.cumsum(n) - n)[rare]
        for k in range(self.places):
            out[start + k] = self.lead + (self.base if k else 0) + number // self.base ** (self.places - 1 - k) % self.base
        return out

    def _restarts(self) -> np.ndarray:
        """(languages, symbols): the state after a symbol that starts a phrase."""
        roots = np.array(self.roots, dtype=np.int32)[:, None]
        first = self.table[(roots * self.width + np.arange(self.width)).ravel()].reshape(len(roots), self.width)
        return np.where(first < 0, roots, first)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) counts of phrases."""
        pieces = np.array([max(1, -(-len(t) // PIECE)) for t in texts])
        grid = np.full((pieces.sum(), PIECE), PAD, dtype=np.int32)
        flat, at = grid.ravel(), 0
        for t, n in zip(texts, pieces, strict=True):
            flat[at : at + len(t)] = t
            at += n * PIECE
        first = np.cumsum(pieces) - pieces
        # A column is a piece of a text in a language; its symbols go down.
        languages, columns = len(self.roots), grid.shape[0]
        grid, restart = np.ascontiguousarray(grid.T), self._restarts().ravel()
        entry = np.repeat(np.array(self.roots, dtype=np.int32), columns)
        trail = np.empty((PIECE, languages * columns), dtype=np.int32)  # states after each symbol
        missed = np.empty((PIECE, languages * columns), dtype=bool)
        begins = np.zeros(columns, dtype=bool)
        begins[first] = True
        inner = np.flatnonzero(~np.tile(begins, languages))

        def parse(which: np.ndarray, settled: bool) -> None:
            """Parse these pieces from their entries; where `settled`, only until they meet the parse before."""
            state, symbol_at, base = entry[which], which % columns, which // columns * self.width
            for k in range(PIECE):
                symbol = grid[k, symbol_at]
                to = self.table.take(state * self.width + symbol)
                miss = to < 0
                state = np.where(miss, restart.take(base + symbol), to)
                if settled:
                    met = trail[k, which] == state
                    missed[k, which], trail[k, which] = miss, state
                    if met.any():
                        apart = ~met
                        which, state, symbol_at, base = which[apart], state[apart], symbol_at[apart], base[apart]
                        if not len(which):
                            return
                else:
                    missed[k, which], trail[k, which] = miss, state

        parse(np.arange(languages * columns), False)
        for sweep in range(SWEEPS + int(pieces.max())):
            changed = inner[trail[-1, inner - 1] != entry[inner]]
            if not len(changed):
                break
            if sweep >= SWEEPS:  # in order: no piece before one that comes next is still wrong
                texts_of = np.searchsorted(first, changed % columns, side="right") + changed // columns * len(first)
                changed = changed[np.unique(texts_of, return_index=True)[1]]
            entry[changed] = trail[-1, changed - 1]
            parse(changed, True)
        count = missed.sum(axis=0, dtype=np.int32).reshape(languages, columns)
        return np.add.reduceat(count, first, axis=1).T + 1

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [self.spelled(symbols(t, self.classes)) if t else np.zeros(0, np.uint8) for t in texts]
        lettered = [len(t) > 0 and bool((t >= OTHER).any()) for t in known]
        out: list[tuple[str, float]] = [(UNDEFINED, 0.0)] * len(texts)
        which = [i for i, ok in enumerate(lettered) if ok]
        if not which or not self.languages:
            return out
        counts, held, pieces = [], [], 0
        for i in which:
            n = -(-len(known[i]) // PIECE)
            if held and (pieces + n) * len(self.languages) > GRID:
                counts.append(self.phrases(held))
                held, pieces = [], 0
            held.append(known[i])
            pieces += n
        cost = np.concatenate([*counts, self.phrases(held)]) * np.array(self.scale)
        for i, row in zip(which, cost, strict=True):
            best = int(np.argmin(row))
            second = np.partition(row, 1)[1] if len(row) > 1 else None
            out[i] = (self.languages[best], 1.0 if second is None else float((second - row[best]) / second))
        return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) mod `folds` is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, training: Column, docs_per_language: int = 60, chars_per_doc: int = 600, model_cells: int = 24_000_000) -> Model:
    """Learn from rows where `training` is true and lang is not null; only the sample reaches the driver."""
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).coalesce(GATHERED).collect()}  # a row for each label
    if not counts:
        return Model({}, chars_per_doc, model_cells)
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(23)), 11) / F.lit(float(1 << 53))
    drawn = known.withColumn("u", draw)
    # Only frequent labels are thinned before they are ranked; the others are few rows each.
    shares = {k: 4.0 * docs_per_language / n for k, n in counts.items() if n > 8 * docs_per_language}
    if shares:
        share = F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
        drawn = drawn.where(F.col("u") < F.coalesce(share, F.lit(1.0)))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))).where(F.col("rank") <= docs_per_language)
    samples: dict[str, list[str]] = {}
    sample = ranked.select("lang", "rank", F.substring("text", 1, 4 * chars_per_doc).alias("text")).coalesce(GATHERED).collect()
    for r in sorted(sample, key=lambda r: r.rank):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples, chars_per_doc, model_cells)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by model_cells

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        keep_only("language")
        found = shared.value.predict(texts.to_pylist())
        return pa.array([{"lang": a, "score": b} for a, b in found], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    kept, found = [c for c in docs.columns if c not in ("lang_pred", "score")], free_name(docs, "found")
    once = predicted.asNondeterministic()  # else a filter on the result would predict again
    out = docs.select(*kept, once(F.col(text)).alias(found))
    return out.select(*kept, F.col(found)["lang"].alias("lang_pred"), F.col(found)["score"].alias("score"))
