"""Language identification by known words first, then by shorter and shorter character n-grams.

A word that some language's list holds is scored by its log frequency there. A word that none holds falls back to its
character n-grams: the longest order of which any n-gram is known scores it, by the mean log frequency. A document's
language is the one with the largest sum over its words.

The counts cover all documents that may be learned from; they are summed in Spark and stay written tables. Every task
holds the words and n-grams that are among the most frequent of any language, ``n_words`` and ``n_grams`` of each order,
with their counts in all languages. What lies outside is looked up by joins of the distinct words with the whole counts,
so these two numbers bound memory and change no result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickline.llm.shared import held_out, only, portions
from brickline.session import settle

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
#: A word's first and last mark inside its n-grams; neither is a letter.
FIRST, LAST = "<", ">"
FLUSH = 200_000
SHARES = 64
#: Words of evidence at which a score stops growing more certain.
FULL_EVIDENCE = 12
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def _counted(batches: Iterator[pa.RecordBatch], count) -> Iterator[pa.RecordBatch]:
    """Sums of ``(lang, token): n`` over batches, given out whenever many have gathered."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["lang", "token", "n"],
        )

    only("language-counts", dict)
    for batch in portions(batches, 2_000):
        for lang, tokens in count(batch):
            for token, n in tokens.items():
                held[lang, token] += n
            if len(held) > FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, token, n`` over every document that may be learned from, with text and language."""

    def count(batch: pa.RecordBatch):
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        yield from by_lang.items()

    learn = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = learn.mapInArrow(lambda it: _counted(it, count), "lang string, token string, n long")
    return counts.groupBy("lang", "token").agg(F.sum("n").alias("n"))


def grams(word: str, size: int) -> list[str]:
    marked = FIRST + word + LAST if size > 1 else word
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, token, n`` of the character n-grams of all counted words, each as often as its word."""

    def count(batch: pa.RecordBatch):
        by_lang: dict[str, Counter] = {}
        for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "token", "n"))):
            held = by_lang.setdefault(lang, Counter())
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams(word, size):
                    held[gram] += n
        yield from by_lang.items()

    counts = words.select("lang", "token", "n").mapInArrow(lambda it: _counted(it, count), "lang string, token string, n long")
    return counts.groupBy("lang", "token").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All rows of the tokens that are among the ``most`` with the largest counts of any key, ties to the smaller token.

    Ranked in ``SHARES`` shares of a key's tokens first, so that one task never sees more than the best of each share.
    """
    share = F.pmod(F.xxhash64("token"), F.lit(SHARES))
    best = counts
    for parts in ([*keys, share], keys):
        order = Window.partitionBy(*parts).orderBy(F.desc("n"), "token")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
    best = settle(best.select("token").distinct(), "language-lists")  # so that its size is known to the join
    return counts.join(best, "token", "left_semi")


class Model:
    """Log frequencies by token for every language; one row each, in the order of the sorted language names.

    ``sums`` has ``lang, size, total`` and ``distinct`` the number of tokens by size, where size 0 stands for the words.
    ``counts`` are the whole tables of words and n-grams; they stay behind when a model is sent to tasks.
    """

    def __init__(self, sums: list, distinct: dict[int, int], words: list, by_size: list, counts: tuple[DataFrame, DataFrame]):
        self.counts = counts
        self.langs = sorted({r["lang"] for r in sums if r["size"] == 0})
        self.place = {lang: k for k, lang in enumerate(self.langs)}
        totals = np.ones((LONGEST_GRAM + 1, len(self.langs)))
        for r in sums:
            totals[r["size"], self.place[r["lang"]]] = r["total"]
        self.whole = np.log(totals + 0.5 * np.array([[distinct.get(k, 0)] for k in range(LONGEST_GRAM + 1)]))
        self.words = self._table(0, words)
        self.grams = [self._table(size, [r for r in by_size if r["size"] == size]) for size in range(LONGEST_GRAM, 0, -1)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def _table(self, size: int, rows: list) -> tuple[dict[str, int], np.ndarray]:
        number: dict[str, int] = {}
        for r in rows:
            number.setdefault(r["token"], len(number))
        counts = np.full((len(number), len(self.langs)), 0.5)
        for r in rows:
            counts[number[r["token"]], self.place[r["lang"]]] = r["n"]
        return number, np.log(counts) - self.whole[size]

    def places(self, word: str) -> tuple[int, list[int]]:
        """Of the tables held here, the one that scores a word, and its rows there: the words' own, or that of the
        longest known n-grams."""
        found = self.words[0].get(word)
        if found is not None:
            return 0, [found]
        for k, size in enumerate(range(LONGEST_GRAM, 0, -1)):
            number = self.grams[k][0]
            known = [number[g] for g in grams(word, size) if g in number]
            if known:
                return k + 1, known
        return 0, []

    def elsewhere(self, word: str) -> set[str]:
        """The n-grams of a word that the tables held here lack."""
        return {g for k, size in enumerate(range(LONGEST_GRAM, 0, -1)) for g in grams(word, size) if g not in self.grams[k][0]}

    def row(self, word: str, cells: list[dict], gram_cells: list[dict]) -> np.ndarray:
        """A word's logs from its own counts, or where it has none from its n-grams, held here or given."""
        if cells:
            return self._table(0, [{"token": word} | c for c in cells])[1][0]
        for k, size in enumerate(range(LONGEST_GRAM, 0, -1)):
            number, logs = self.grams[k]
            more, more_logs = self._table(size, [c for c in gram_cells if len(c["token"]) == size])
            known = [logs[number[g]] if g in number else more_logs[more[g]] for g in grams(word, size) if g in number or g in more]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))


def learn(docs: DataFrame, n_words: int = 20_000, n_grams: int = 5_000) -> Model:
    """A model of every language in the table. Only its bounded lists come to the driver, never the counts."""
    words = settle(word_counts(docs), "language-words")
    by_size = settle(gram_counts(words).withColumn("size", F.length("token")), "language-grams")
    both = words.withColumn("size", F.lit(0)).unionByName(by_size)
    sums = both.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()
    distinct = dict(both.select("size", "token").distinct().groupBy("size").count().collect())
    lists = _most_frequent(words, ["lang"], n_words).collect(), _most_frequent(by_size, ["lang", "size"], n_grams).collect()
    return Model(sums, distinct, *lists, (words, by_size))


#: ``rest`` are distinct words between blanks, ``times`` how often each is there.
TEXTS = "key binary, n_words long, known array<double>, rest string, times array<int>"


def _text_key():
    """Names a text; null for a null text. Only texts decide, so copies share a verdict."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _read(docs: DataFrame, shared, name: str) -> DataFrame:
    """Each text once: the summed logs of the words that the model holds, and its other words with their counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = only(("languages", name), lambda: shared.value)
        number, logs = model.words
        for batch in portions(batches):
            sizes, known, rest, times = [], [], [], []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                others = Counter(words[k] for k in np.flatnonzero(at < 0))
                sizes.append(len(words))
                known.append(logs[at[at >= 0]].sum(0))
                rest.append(" ".join(others))
                times.append(list(others.values()))
            columns = zip((sizes, [k.tolist() for k in known], rest, times), (pa.int64(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], *(pa.array(c, t) for c, t in columns)], names=["key", "n_words", "known", "rest", "times"]
            )

    texts = docs.where(F.col("text").isNotNull()).select(_text_key().alias("key"), "text")
    once = texts.mapInArrow(read, TEXTS).dropDuplicates(["key"])
    return settle(once.withColumn("id", F.monotonically_increasing_id()), "language-texts")


def _looked_up(words: DataFrame, model: Model, shared, name: str) -> DataFrame:
    """``word, logs`` of distinct words that the model does not hold, from the whole counts."""
    of_words, of_grams = model.counts
    cell = F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))
    own = words.join(of_words.withColumnRenamed("token", "word"), "word", "left").groupBy("word").agg(F.collect_list(cell).alias("cells"))
    own = settle(own, "language-asked")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = only(("languages", name), lambda: shared.value)
        for batch in portions(batches):
            pairs = [(w, g) for w in batch["word"].to_pylist() for g in model.elsewhere(w)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["word", "token"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = only(("languages", name), lambda: shared.value)
        for batch in portions(batches):
            logs = [model.row(*r).tolist() for r in zip(*(batch[c].to_pylist() for c in ("word", "cells", "gram_cells")))]
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(logs, pa.list_(pa.float64()))], names=["word", "logs"])

    unseen = own.where(F.size("cells") == 0).select("word").mapInArrow(take_apart, "word string, token string")
    by_gram = unseen.join(of_grams, "token").groupBy("word").agg(F.collect_list(F.struct("token", "lang", "n")).alias("gram_cells"))
    rows = own.join(by_gram, "word", "left").select("word", "cells", F.coalesce("gram_cells", F.array()).alias("gram_cells"))
    return settle(rows.mapInArrow(score, "word string, logs array<double>"), "language-rows")


def _verdicts(docs: DataFrame, model: Model) -> DataFrame:
    """``key, lang_pred, score`` of every text that is not null, written."""
    shared, name, n = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, len(model.langs)
    texts = _read(docs, shared, name)
    pairs = texts.where("rest <> ''").select("id", F.inline(F.arrays_zip(F.split("rest", " ").alias("word"), F.col("times").alias("n"))))
    rows = _looked_up(pairs.select("word").distinct(), model, shared, name)
    sums = [F.sum(F.col("n") * F.get("logs", F.lit(k))).alias(f"s{k}") for k in range(n)]
    found = pairs.join(rows, "word").groupBy("id").agg(*sums).select("id", F.array(*(f"s{k}" for k in range(n))).alias("found"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = only(("languages", name), lambda: shared.value).langs
        for batch in batches:
            out = []
            for words, known, more in zip(*(batch[c].to_pylist() for c in ("n_words", "known", "found"))):
                out.append(_verdict(langs, words, np.array(known) + (0.0 if more is None else np.array(more))))
            columns = [batch["key"], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score"])

    decided = texts.select("id", "key", "n_words", "known").join(found, "id", "left").mapInArrow(decide, "key binary, lang_pred string, score double")
    return settle(decided, "language-verdicts")


def _verdict(langs: list[str], n_words: int, total: np.ndarray) -> tuple[str, float]:
    if not n_words:
        return UNKNOWN, 0.0
    best = int(total.argmax())
    certain = (total - total[best]) * (min(n_words, FULL_EVIDENCE) / n_words)
    return langs[best], float(1.0 / np.exp(certain).sum())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    ``und`` with score 0 where the text is null or has no letter, or where there was nothing to learn from. Ties go to
    the name that sorts first. Each row stands alone, repeated rows alike; other columns are left behind.
    """
    model = model or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), _text_key().alias("key"))
    if not model.langs:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.join(_verdicts(docs, model), "key", "left").select(
        "doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a letter, with all their columns and ``lang`` as found; the others go.

    Where there was nothing to learn from, documents keep the language they came with.
    """
    names, model = docs.columns, learn(docs)
    if model.langs:
        found = _verdicts(docs, model).where(F.col("lang_pred") != UNKNOWN)
        found = found.select(F.col("key").alias("__key"), F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("__lang"))
        kept = docs.withColumn("__key", _text_key()).join(found, "__key")
        return kept.select(*(F.col("__lang").alias("lang") if n == "lang" else F.col(f"`{n}`") for n in names))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield batch.filter(pa.array([bool(words_of(t or "")) for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
