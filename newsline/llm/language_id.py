"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased and reduced to words of letters; a word is the letters between two
word marks, and contexts don't cross words. For each order up to ``ORDER`` the model keeps
one sorted array of n-gram hashes and, beside it, a column of log probabilities for each
language (lower orders count continuations, so a letter is likely where it follows many
different ones). A text's language is the one with the lowest cross-entropy a symbol; the
texts whose best cross-entropy is beyond what labelled texts ever show are rejected.

The models are fitted on at most ``PER_LANGUAGE`` documents of each language, and the bound
of rejection on half as many others, all the first by a hash of doc_id. Tasks count the n-grams
and score the calibration texts, so the driver gets counts of n-grams and one number a
language, never texts; the number of languages is taken to be small. Everything else covers
all rows. A task scores each different word of a slice once.

Nulls: a null text, one without letters, or any text when nothing could be learned is
``und`` with score 0 and rejected. Rows with null lang or doc_id are predicted, never
learned from. Repeated rows get equal results; an empty table an empty one.
"""

from __future__ import annotations

import functools
import pickle
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsline.llm.common import bounded_batches, mix, powers, released, rolling
from newsline.plans.storage import materialize, table

ORDER = 4
PER_LANGUAGE = 800
SLACK = 1.1
RANK_BITS = 16
SLICE_CHARS = 500_000
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = ord(chr(c).lower()[0])
    return out


def _word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, word starts, word ends, text number of each word) of the letters of ``texts``."""
    joined = "\n".join([*texts, ""])
    symbols = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_letter = np.append(symbols > 0, False)
    before = np.append(False, is_letter[:-1])
    starts, ends = np.flatnonzero(is_letter & ~before), np.flatnonzero(~is_letter & before)
    bounds = np.cumsum([len(x) + 1 for x in texts])
    return symbols, starts, ends, np.searchsorted(bounds, starts, "right")


def _spelled(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word between two marks (0), one after another: (symbols, place in the word, first place of each)."""
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    out = np.zeros(len(place), np.uint64)
    inner = (place > 0) & (place < np.repeat(lengths, lengths) - 1)
    out[inner] = symbols[(np.repeat(starts, lengths) + place - 1)[inner]]
    return out, place, first


def _gram_hash(grams: list[str], n: int) -> np.ndarray:
    """The hash that ``rolling`` gives the gram's symbols; a word mark is written as a space."""
    flat = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
    flat = np.where(flat == 32, np.uint64(0), flat)
    return mix((mix(flat + np.uint64(1)) * powers(3, n + 1)[:n]).sum(axis=1, dtype=np.uint64))


class Models:
    """Kneser-Ney tables of all languages, by order."""

    def __init__(self, counts: dict[str, dict[int, Counter]]) -> None:
        self.languages = sorted(counts)
        size = len(self.languages)
        alphabet = len({g for c in counts.values() for g in c[1]}) + 1
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = np.full(size, -np.log(alphabet)) if size else np.zeros(0)
        lower_index: dict[str, int] = {}
        lower = np.zeros((0, size))
        for n in range(1, ORDER + 1):
            names = sorted({g for c in counts.values() for g in c[n]})
            table_ = np.array([[counts[x][n].get(g, 0) for x in self.languages] for g in names], float).reshape(len(names), size)
            context_names = sorted({g[:-1] for g in names})
            context_index = {h: i for i, h in enumerate(context_names)}
            context = np.array([context_index[g[:-1]] for g in names], int)
            total, kinds = np.zeros((len(context_names), size)), np.zeros((len(context_names), size))
            np.add.at(total, context, table_)
            np.add.at(kinds, context, table_ > 0)
            ones, twos = (table_ == 1).sum(0), (table_ == 2).sum(0)
            discount = np.clip(np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.95)
            below = np.exp(self.floor)[None, :] if n == 1 else np.exp(lower[[lower_index[g[1:]] for g in names]])
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.where(total[context] > 0, np.maximum(table_ - discount, 0) / np.maximum(total[context], 1), 0) + weight[context] * below
            lower, lower_index = np.log(p), {g: i for i, g in enumerate(names)}
            self.grams.append(self._sorted(_gram_hash(names, n), lower))
            self.contexts.append(self._sorted(_gram_hash(context_names, n - 1), np.log(weight)) if n > 1 else (np.zeros(1, np.uint64), np.log(weight)))
        self.bound = np.full(size, np.inf)

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def word_scores(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word and its end mark under each language."""
        flat, place, first = _spelled(symbols, starts, ends)
        mixed = mix(flat + np.uint64(1))
        hashes = [None] + [rolling(mixed, n) for n in range(1, ORDER + 1)]
        predicted = np.flatnonzero(place > 0)
        out = np.zeros((len(flat), len(self.languages)), np.float32)
        todo, order = predicted, np.minimum(place[predicted] + 1, ORDER)
        for n in range(ORDER, 0, -1):
            now = order == n
            at = todo[now]
            row, found = self._find(self.grams[n - 1][0], hashes[n][at - n + 1])
            out[at[found]] += self.grams[n - 1][1][row[found]]
            miss = at[~found]
            if n > 1:
                row, found = self._find(self.contexts[n - 1][0], hashes[n - 1][miss - n + 1])
                out[miss[found]] += self.contexts[n - 1][1][row[found]]
            else:
                out[miss] += (self.contexts[0][1][0] + self.floor).astype(np.float32)
            todo, order = np.append(todo[~now], miss), np.append(order[~now], np.full(len(miss), n - 1))
        return np.add.reduceat(out, first, axis=0)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a symbol in nats of each text by language, number of symbols)."""
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        symbols, starts, ends, text = _word_runs(texts)
        if len(starts) and self.languages:
            lengths = ends - starts
            first = np.cumsum(lengths) - lengths
            inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            parts = mix(symbols[np.repeat(starts, lengths) + inside].astype(np.uint64)) * powers(5, int(lengths.max()))[inside]
            _, one, which = np.unique(mix(np.add.reduceat(parts, first)) + lengths.astype(np.uint64), return_index=True, return_inverse=True)
            scores = self.word_scores(symbols, starts[one], ends[one])
            for j in range(len(self.languages)):
                total[:, j] = np.bincount(text, scores[which, j], len(texts))
            size = np.bincount(text, lengths + 1, len(texts)).astype(np.int64)
        return -total / np.maximum(size, 1)[:, None], size


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): n-grams of the highest order, and shorter ones at a word's start; a word mark is a space."""
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            symbols, _, _, _ = _word_runs([text or ""])
            words[lang].update(symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").replace("\0", " ").split())
        rows = []
        for lang, seen in words.items():
            own: Counter = Counter()
            for word, times in seen.items():
                marked = f" {word} "
                for i in range(1, len(marked)):
                    own[marked[i - min(ORDER, i + 1) + 1 : i + 1]] += times
            rows += [(lang, g, n) for g, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])


def _counts(rows: list) -> dict[str, dict[int, Counter]]:
    """Counts of the highest order; continuation counts below, but plain ones for grams at a word's start."""
    out: dict[str, dict[int, Counter]] = {}
    for lang, gram, times in rows:
        out.setdefault(lang, {n: Counter() for n in range(1, ORDER + 1)})[len(gram)][gram] += times
    for own in out.values():
        for n in range(ORDER, 1, -1):
            own[n - 1].update(Counter(g[1:] for g in own[n]))
    return out


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Models:
    """Models of the languages in (doc_id, text, lang); rows with a null lang teach nothing."""
    bounded_batches(labelled.sparkSession)
    most = per_language + per_language // 2
    rows = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    rows = rows.withColumn("b", F.shiftright("h", 64 - RANK_BITS))
    # Counts by the leading bits tell up to where a language's first rows lie, so no task ranks all of a language.
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("b"))
    last = rows.groupBy("lang", "b").count().withColumn("upto", upto).where(F.col("upto") >= most).groupBy("lang").agg(F.min("b").alias("last"))
    some = rows.join(F.broadcast(last), "lang", "left").where("last is null or b <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = some.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "lang", "rank")
    sample = materialize(labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text", "rank"), "sample")
    grams = sample.where("rank % 3 != 0").select("lang", "text").mapInArrow(released(_grams), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n"))
    models = Models(_counts([tuple(r) for r in grams.collect()]))
    if models.languages:
        told = predict_rows(sample.where("rank % 3 = 0"), models).where("lang = _language.lang_pred").groupBy("lang").agg(F.max("_language.cross_entropy").alias("most"))
        for lang, most_seen in told.collect():
            models.bound[models.languages.index(lang)] = SLACK * most_seen
    return models


def predict_rows(docs: DataFrame, models: Models, name: str = "_language") -> DataFrame:
    """``docs`` with a struct ``name`` of lang_pred, score, rejected and cross_entropy (nats a symbol, null if undetermined), from the column text; nothing is shuffled."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name} already")
    bounded_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    kept = docs.columns
    text = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models = pickle.loads(packed.value)
        names = [*own.languages, UNDETERMINED]
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and n < SLICE_CHARS:
                    n += len(texts[to])
                    to += 1
                entropy, size = own.entropies(texts[at:to])
                known = (size > 0) & bool(own.languages)
                if own.languages:
                    best = entropy.argmin(1)
                    low = entropy[np.arange(to - at), best]
                    odds = np.exp(-np.minimum((entropy - low[:, None]) * np.minimum(size, 32)[:, None], 60))
                    score = np.where(known, 1 / odds.sum(1), 0.0)
                    rejected = ~known | (low > own.bound[best])
                else:
                    best, score, rejected, low = np.zeros(to - at, int), np.zeros(to - at), np.ones(to - at, bool), np.zeros(to - at)
                pred = [names[b] if k else UNDETERMINED for b, k in zip(best, known)]
                found = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected), pa.array(low, pa.float64(), mask=~known)], ["lang_pred", "score", "rejected", "cross_entropy"])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns), found], [*kept, name])
                at = to

    return docs.select(kept).mapInArrow(released(run), docs.select(kept).schema.add(name, StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("cross_entropy", "double")))


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy) of every row of (doc_id, text)."""
    return predict_rows(docs.select("doc_id", "text"), models).select("doc_id", "_language.*")


def held_out() -> F.Column:
    """Documents never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    models = learn(docs.where(~held_out()))
    return predict(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
