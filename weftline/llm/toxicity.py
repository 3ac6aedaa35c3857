"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes homoglyphs and digit substitutions. The lexicon's entries are word
stems (or whole words) with the weight that labelled rows give them; the sum of the
matched weights, and that sum by length, make the score. Matches inside exception
phrases do not count.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import narrow, remainder, steps
from weftline.runtime import materialize, table

#: Labelled rows of each class that a lexicon is learnt from at most, those first by
#: a hash of the key.
TRAIN_ROWS = 6_000
#: Lengths of the word beginnings that may become entries.
SHORTEST, LONGEST = 3, 10
#: What an entry needs: toxic rows that hold it, and how improbable that is by chance. A
#: longer beginning that SAME of an entry's toxic rows hold takes its place.
LEAST_ROWS, CHANCE, SAME = 4, 1e-5, 0.95
#: The share of toxic rows among those that hold an entry is one of these: the one with the
#: least loss when the lexicon of all but one fold of the learning rows scores that fold.
PURITIES, FOLDS = (0.6, 0.75, 0.9, 0.97), 3

#: Characters that look like Latin letters, and digits and signs that
#: stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "օ": "o", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l",
    "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e",
    "ᴋ": "k", "ᴍ": "m", "ᴘ": "p", "ᴛ": "t", "ƅ": "b", "ԍ": "g", "ӏ": "l", "ⲟ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: Characters without width that may split a word.
UNSEEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿͏"))
#: Phrases in which a word of the lexicon is harmless, beside those learnt.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash cans", "trash collection", "clown fish", "clown car", "pond scum", "sore loser rule", "idiot proof", "stupid simple")

GLYPHS = str.maketrans(HOMOGLYPHS) | UNSEEN
WORD = re.compile(r"[^\W_]+")
#: A word in which letters stand beside digits or signs for letters.
MIXED = re.compile(r"(?=[^\s]*[^\W\d_])[\w@$!|€]*[0-9@$!|€][\w@$!|€]*")
SIGNS = str.maketrans(DIGITS)


def _unmask(m: re.Match) -> str:
    """Signs at a word's end are punctuation, those at its start or within are letters."""
    word = m[0]
    bare = word.rstrip("!|$@€")
    return bare.translate(SIGNS) + " " * (len(word) - len(bare))


def fold(text: str) -> str:
    """Lower case, compatibility forms, Latin letters for look-alikes and digits."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(GLYPHS)
    return MIXED.sub(_unmask, text)


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


@dataclass
class Lexicon:
    """Weights of entries (a stem, or a whole word if it ends in a space), and the
    coefficients that turn matches into a score. Its size is bounded by the words of
    the rows that taught it: each entry stands in LEAST_ROWS of them."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def matcher(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(" " + entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {' '.join(words(phrase))} ", (-len(phrase) - 1, 0.0))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def phrases(self, matcher: ahocorasick.Automaton | None, text: str | None) -> set[str]:
        """Pairs of neighbouring words, the first or the second of which an entry matches."""
        said = words(text)
        if not said or matcher is None:
            return set()
        line = f" {' '.join(said)} "
        starts = {end - size for end, (size, _) in matcher.iter(line) if size > 0}
        at, found = 0, set()
        for i, w in enumerate(said):
            if at in starts:
                found.update(" ".join(said[k : k + 2]) for k in (i - 1, i) if 0 <= k < len(said) - 1)
            at += len(w) + 1
        return found

    def features(self, matcher: ahocorasick.Automaton | None, text: str | None) -> tuple[float, float]:
        """Sum of the weights of the words matched (each word by its heaviest entry),
        and that sum by a hundred words, both as logarithms."""
        return self.features_of(matcher, words(text))

    def features_of(self, matcher: ahocorasick.Automaton | None, said: list[str]) -> tuple[float, float]:
        if not said or matcher is None:
            return 0.0, 0.0
        line = f" {' '.join(said)} "
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in matcher.iter(line):
            if size < 0:
                spared.append((end + size, end))
            else:
                start = end - size
                hits[start] = max(hits.get(start, 0.0), weight)
        total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in spared))
        return math.log1p(total), math.log1p(100 * total / len(said))

    def score(self, features: tuple[float, float]) -> float:
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * features[0] + c * features[1]))))


def _sample(texts: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(key, text, toxic) of at most `rows` keys of each class, by hash of the key. Only
    keys and labels are joined and sorted; what is chosen, at most 2 * rows of them,
    is sent to the texts. Of several texts of a key the first in order teaches."""
    known = labels.join(texts.where("text is not null").select("key"), "key", "left_semi").distinct()
    order = [F.xxhash64(F.col("key").cast("string")), "key"]
    pick = lambda label: known.where(F.col("toxic") == label).orderBy(*order).limit(rows)
    chosen = pick(1).unionByName(pick(0))
    return texts.where("text is not null").join(F.broadcast(chosen), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))


def learn(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most `rows` labelled rows of each class: texts (key, text)
    with labels (key, toxic).

    Rows with a null key, text or label, and labels other than 0 and 1, are passed
    over. Every word beginning of SHORTEST to LONGEST letters, and every whole word,
    is counted by the rows of either class that hold it; an entry is the shortest
    beginning that is pure enough and no accident, or the longer one that is nearly
    always meant by it, weighted by its log odds. Exceptions are `exceptions` and the
    pairs of words that hold an entry in LEAST_ROWS clean rows and in no toxic one. The
    coefficients are those of a logistic regression on the same rows. A key that has
    both labels teaches both, a repeated row once. Too few toxic rows give an empty lexicon,
    whose scores are all low."""
    known = narrow(labels, key=key, toxic=toxic).where("key is not null and toxic in (0, 1)")
    sample = _sample(narrow(texts, key=key, text=text), known, rows)
    sample = materialize(sample.withColumn("fold", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(1)), F.lit(FOLDS)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(2 * FOLDS)]
        for batch in steps(batches):
            for t, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                seen = set()
                for w in set(words(t)):
                    seen.update([w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1)])
                    seen.add(w + " ")
                held[2 * fold + label].update(seen)
            if sum(map(len, held)) > 400_000:
                yield from _counted(held)
                held = [Counter() for _ in range(2 * FOLDS)]
        yield from _counted(held)

    # c0 to c5: the clean and toxic rows of each fold that hold an entry.
    columns = [f"c{i}" for i in range(2 * FOLDS)]
    features = sample.mapInArrow(count, "entry string, " + ", ".join(f"{c} long" for c in columns)).groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns])
    sizes = np.zeros((FOLDS, 2), int)
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r.fold, r.toxic] = r["count"]
    parts = [[g for g in range(FOLDS) if g != fold] for fold in range(FOLDS)] + [list(range(FOLDS))]  # the last one: all
    if not sizes[:, 1].sum():
        return Lexicon(exceptions=exceptions)
    likely = []
    for part in parts:
        toxic_, clean = (sum((F.col(f"c{2 * g + label}") for g in part), F.lit(0)) for label in (1, 0))
        likely.append((toxic_ >= LEAST_ROWS) & (toxic_ >= min(PURITIES) * (toxic_ + clean)))
    likely = features.where(functools.reduce(lambda x, y: x | y, likely)).collect()  # of at most `rows` toxic rows, LEAST_ROWS of which hold each
    counts = np.array([[r[c] for c in columns] for r in likely], int).reshape(len(likely), FOLDS, 2)

    def lexicon_of(part: list[int], purity: float) -> Lexicon:
        held = counts[:, part].sum(axis=1).tolist()
        n_clean, n_toxic = sizes[part].sum(axis=0).tolist()
        return Lexicon(_entries({r.entry: (t, c) for r, (c, t) in zip(likely, held)}, n_toxic, n_clean, purity), exceptions)

    tried = [lexicon_of(part, purity) for purity in PURITIES for part in parts[:-1]]
    taught = _measured(sample, tried)
    losses = []
    for k, _ in enumerate(PURITIES):
        loss = 0.0
        for fold in range(FOLDS):
            i = k * FOLDS + fold
            x, y, own = taught[:, [2 * i, 2 * i + 1]], taught[:, -2], taught[:, -1] == fold
            w = _regress(x[~own], y[~own])
            p = 1 / (1 + np.exp(-np.clip(w[0] + x[own] @ w[1:], -50, 50)))
            loss -= float(np.log(np.clip(np.where(y[own] == 1, p, 1 - p), 1e-9, 1)).sum())
        losses.append(loss)
    purity = max(zip([-x for x in losses], PURITIES))[1]
    lexicon = lexicon_of(parts[-1], purity)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in steps(batches):
            held = (Counter(), Counter())
            for t, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                held[label].update(lexicon.phrases(matcher, t))
            yield from _counted(held)

    # Two words, one of which matches, that clean rows hold and toxic ones do not.
    spared = sample.mapInArrow(phrases, "entry string, c0 long, c1 long").groupBy("entry").agg(F.sum("c0").alias("clean"), F.sum("c1").alias("toxic"))
    learnt = spared.where((F.col("clean") >= LEAST_ROWS) & (F.col("toxic") == 0)).orderBy("entry").collect()  # of at most `rows` clean rows, LEAST_ROWS of which hold each
    lexicon.exceptions = (*exceptions, *(r.entry for r in learnt))

    taught = _measured(sample, [lexicon])
    lexicon.coefficients = _regress(taught[:, :2], taught[:, 2])
    return lexicon


def _measured(sample: DataFrame, lexicons: list[Lexicon]) -> np.ndarray:
    """For each row of the sample its two features by each lexicon, toxic and fold: a
    bounded table of numbers, in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [x.matcher() for x in lexicons]
        for batch in steps(batches):
            said = [words(t) for t in batch.column("text").to_pylist()]
            found = np.array([[n for x, m in zip(lexicons, matchers) for n in x.features_of(m, w)] for w in said], float)
            rows = np.hstack([found, np.array([batch.column("toxic").to_pylist(), batch.column("fold").to_pylist()], float).T])
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], ["row"])

    rows = sample.mapInArrow(run, "row array<double>").toArrow()["row"].to_pylist()
    return np.array(rows, float).reshape(len(rows), 2 * len(lexicons) + 2)


def _entries(counted: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, purity: float) -> dict[str, float]:
    """Entries and their weights, of the toxic and clean rows that hold each."""
    if not n_toxic:
        return {}
    share, scale = n_toxic / (n_toxic + n_clean), n_clean / n_toxic
    pure = {e: (t, c) for e, (t, c) in counted.items() if t >= LEAST_ROWS and t >= purity * (t + c) and t * scale >= purity * (t * scale + c)}
    sound = {e: (t, c) for e, (t, c) in pure.items() if _chance(t, t + c, share) <= CHANCE}
    # Of a beginning and longer ones that nearly as many rows hold, the longest is meant.
    meant: dict[str, str] = {}
    for e in sorted(sound, key=lambda e: (len(e), e)):
        for n in range(SHORTEST, len(e)):
            if (short := meant.get(e[:n])) and sound[e][0] >= SAME * sound[e[:n]][0] and len(e) > len(short):
                meant[e[:n]] = e
        meant.setdefault(e, e)
    entries = {}
    for e in sorted(sound, key=lambda e: (-sound[e][0], len(e), e)):
        if not any(e[:n] in sound for n in range(SHORTEST, len(e))):
            t, c = sound[meant[e]]
            entries[meant[e]] = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return entries


def _counted(held: Sequence[Counter]) -> Iterator[pa.RecordBatch]:
    """Rows of an entry and its count in each of the counters."""
    keys = list(set().union(*held))
    for i in range(0, len(keys), 20_000):
        part = keys[i : i + 20_000]
        yield pa.RecordBatch.from_pydict({"entry": part} | {f"c{i}": [x[k] for k in part] for i, x in enumerate(held)})


def _chance(hits: int, n: int, share: float) -> float:
    """Probability that at least `hits` of n rows are toxic if each is with this share."""
    if share >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share) for k in range(hits, n + 1)]
    return sum(map(math.exp, logs))


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float, float]:
    """Newton steps of a ridge logistic regression with an intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, penalty, penalty])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    # More matches never make a text less toxic.
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): toxicity of every whole text, from 0 to 1.

    A null or empty text scores as one without matches. Rows come out as they went
    in, repeated ones too, null keys kept; other columns are left out. No shuffle:
    the lexicon is broadcast, and texts are read in bounded steps."""
    rows = narrow(df, key=key, text=text)
    held = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = held.value
        matcher = use.matcher()
        for batch in steps(batches):
            found = [use.score(use.features(matcher, t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.float64())], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels never teach: crc32 of the key as text divisible by 5."""
    return F.coalesce(remainder(F.col(key), 5) == 0, F.lit(False))


def learn_documents(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """From the documents' texts and `labels.toxic`, held-out rows aside."""
    return learn(documents, labels.where(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels not held out."""
    documents = table(spark, sf_dir, "documents")
    found = score(documents, learn_documents(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
