"""Language ID, words first: known words by log frequency, unseen ones by ever shorter character n-grams."""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podia.llm.common import free_name, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the model is fitted on, as expected by a hash of the id and dealt out evenly among the
#: languages: all rows of a language that has fewer than its quota.
SAMPLE_ROWS = 20_000
#: Words and n-grams of each length that the model keeps, those with the largest share of a language first: the bound
#: of what is broadcast. Words beyond it are scored like any unseen word, by their n-grams.
MAX_WORDS, MAX_GRAMS, LONGEST = 50_000, 20_000, 5
#: Letters of a run that are one word at most, and how many of them the next stretch of a longer run repeats.
LONG_RUN, OVERLAP = 64, 4
#: Unseen words whose scores a worker remembers before it forgets them all.
REMEMBER = 50_000
#: Different words or n-grams that a worker counts, about, before it hands its counts on, to be added up by Spark.
MOST_KEYS = 20_000
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    """Stretches of n characters of a word framed by < and >; of one character, those of the word itself."""
    framed = f"<{word}>" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def runs(text: str) -> list[str]:
    """Runs of letters in lower case; one of over LONG_RUN as stretches of that length, each OVERLAP into the one before."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONG_RUN:
        return found
    step = LONG_RUN - OVERLAP
    return [w[i : i + LONG_RUN] for w in found for i in range(0, max(1, len(w) - OVERLAP), step)]


class _Places(dict):
    """Places of words in a table; a word asked for the first time gets the next one."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


@dataclass
class Model:
    """Log frequencies by language of words, and of n-grams by length."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_scores: dict[int, np.ndarray]
    places: _Places | None = None
    rows: np.ndarray | None = None

    def __post_init__(self) -> None:
        """All n-grams' scores in one table, shorter ones first, and where a length begins in it; the last row, of zeros, is no n-gram's."""
        sizes = [n for n in range(1, LONGEST + 1) if n in self.grams]
        self._starts = dict(zip(sizes, np.cumsum([0, *(len(self.gram_scores[n]) for n in sizes)]).tolist(), strict=False))
        self._all_grams = np.vstack([*(self.gram_scores[n].reshape(-1, len(self.langs)) for n in sizes), np.zeros((1, len(self.langs)))])

    def _known_grams(self, word: str) -> list[int]:
        """Rows of the word's longest known n-grams; that of zeros if none is known."""
        framed = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            line, at, start = framed if n > 1 else word, self.grams[n], self._starts[n]
            known = [at[g] + start for i in range(len(line) - n + 1) if (g := line[i : i + n]) in at]
            if known:
                return known
        return [len(self._all_grams) - 1]

    def of_all_unseen(self, words: list[str]) -> np.ndarray:
        """of_unseen() of each word, summed up in one go: most unseen words come just once."""
        known = [self._known_grams(w) for w in words]
        many = np.array([len(k) for k in known])
        return np.add.reduceat(self._all_grams.take(list(chain.from_iterable(known)), axis=0), np.cumsum(many) - many) / many[:, None]

    def of_unseen(self, word: str) -> np.ndarray:
        """The mean over the word's longest known n-grams; zeros if none is known."""
        return self.of_all_unseen([word])[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihood of all; `und` and 0 for null and texts without a letter."""
        found = runs(text) if text else []
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        total = self.prior.copy()
        for at in range(0, len(found), REMEMBER // 4):
            part = found[at : at + REMEMBER // 4]
            if self.rows is None or len(self.places) + len(part) > len(self.rows):
                if self.rows is None:
                    self.rows = np.vstack([self.word_scores, np.zeros((REMEMBER, len(self.langs)))])
                self.places = _Places(self.words)
            before = len(self.places)
            at_rows = np.fromiter(map(self.places.__getitem__, part), np.intp, len(part))
            if new := list(islice(reversed(self.places), len(self.places) - before)):
                self.rows[before : len(self.places)] = self.of_all_unseen(new[::-1])
            total += self.rows.take(at_rows, axis=0).sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def _emitted(found: Counter, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """A count's keys and numbers as rows; the count is emptied."""
    columns = [*zip(*found), list(found.values())] if found else [[] for _ in names]
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()]
    found: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.update((lang, w) for w in runs(text.as_py()))
            if len(found) > MOST_KEYS:
                yield _emitted(found, names, types)
    yield _emitted(found, names, types)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["lang", "size", "word", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
    found: Counter[tuple[str, int, str]] = Counter()
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    found[lang, size, g] += n
            if len(found) > MOST_KEYS:
                yield _emitted(found, names, types)
    yield _emitted(found, names, types)


def quotas(by_lang: dict[str, int], rows: int) -> dict[str, float]:
    """Rows to sample of each language, `rows` in all: equal quotas; what small languages leave goes to the others."""
    found, left = {}, float(rows)
    for i, lang in enumerate(sorted(by_lang, key=by_lang.get)):
        found[lang] = min(by_lang[lang], left / (len(by_lang) - i))
        left -= found[lang]
    return found


def _table(rows: list, langs: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Places of words and their log frequencies, as if each language had as many words as the largest.

    So a word that a language lacks scores the same in all languages, however few of their words were sampled.
    """
    at = {lang: i for i, lang in enumerate(langs)}
    index: dict[str, int] = {}
    for r in rows:
        index.setdefault(r["word"], len(index))
    counts = np.zeros((len(index), len(langs)))
    for r in rows:
        counts[index[r["word"]], at[r["lang"]]] = r["n"]
    whole = np.array([max(1, totals.get(lang, 0)) for lang in langs], float)
    common = whole.max(initial=1)
    return index, np.log((counts * (common / whole) + 0.5) / (common + 0.5 * max(1, len(index))))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """A model of the rows whose text and language are not null.

    It is fitted on about sample_rows of them, with an equal quota for each
    language (all rows of one that has fewer), chosen by a hash of the id, or
    of the text where the id is null. Languages without a sampled word aren't
    learned. Words and n-grams are counted by Spark, and the driver receives
    only max_words words and max_grams n-grams of each length with their counts
    by language: those with the largest share of a language's own.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    by_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not by_lang:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, {})
    spark, whole = labelled.sparkSession, 1 << 40
    limits = [(lang, math.ceil(quota / by_lang[lang] * whole)) for lang, quota in quotas(by_lang, sample_rows).items()]
    limits = F.broadcast(spark.createDataFrame(limits, "lang string, most long"))
    sample = rows.join(limits, "lang").filter(F.pmod(F.xxhash64(F.coalesce("id", "text"), F.lit("fit")), F.lit(whole)) < F.col("most")).select("lang", "text")
    counts = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    word_totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(word_totals)
    if not langs:
        counts.unpersist()
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, {})
    prior = np.log(np.array([by_lang[x] for x in langs]) / sum(by_lang[x] for x in langs))

    def kept(frame: DataFrame, most: int, totals: dict[str, int]) -> list:
        own = F.broadcast(spark.createDataFrame(list(totals.items()), "lang string, own long"))
        top = frame.join(own, "lang").groupBy("word").agg(F.max(F.col("n") / F.col("own")).alias("share"))
        top = top.orderBy(F.desc("share"), "word").limit(most)
        return frame.join(top, "word").select("lang", "word", "n").orderBy("word", "lang").collect()

    words, word_scores = _table(kept(counts, max_words, word_totals), langs, word_totals)
    per_gram = counts.mapInArrow(_count_grams, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n")).persist()
    totals = {(r["size"], r["lang"]): r["n"] for r in per_gram.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    index, scores = {}, {}
    for size in range(1, LONGEST + 1):
        own = {x: totals.get((size, x), 0) for x in langs}
        index[size], scores[size] = _table(kept(per_gram.filter(F.col("size") == size), max_grams, {x: max(1, n) for x, n in own.items()}), langs, own)
    per_gram.unpersist()
    counts.unpersist()
    return Model(langs, prior, words, word_scores, index, scores)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its score from 0 to 1.

    `und` with score 0 for a null text, a text without a letter, and where the
    model has learned no language. Ties go to the language first in order.
    Repeated rows get equal answers; an empty table stays empty; columns that
    have the names of the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    docs = docs.drop(pred_col, score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(at)]
            said = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *said], [*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))


def accept(docs: DataFrame, model: Model, text_col: str = "text", languages: list[str] | None = None, least: float = 0.0, pred_col: str | None = None, score_col: str | None = None) -> DataFrame:
    """docs without the rows whose predicted language isn't wanted or whose score is below `least`.

    languages are the wanted ones, by default all that the model has learned;
    `und` never is. The prediction stays with the row under pred_col and
    score_col where these are given; else the columns stay as they are, whatever their names.
    """
    pred, score = pred_col or free_name(docs, "lang_pred"), score_col or free_name(docs, "score")
    wanted = F.col(pred).isin([x for x in (model.langs if languages is None else languages) if x != UNKNOWN])
    kept = identify(docs, model, text_col, pred, score).filter(wanted & (F.col(score) >= least))
    return kept.drop(*[c for c, given in ((pred, pred_col), (score, score_col)) if given is None])
