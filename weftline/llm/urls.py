"""URL filters: host and path rules first, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import narrow
from weftline.runtime import table

#: Rules as (verdict, host, path); the contract's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Words that name what is not wanted and what is, from general knowledge, by subject.
UNWANTED = """
casino poker roulette blackjack jackpot slots bets betting bingo lottery wager gambling
pills pharmacy viagra cialis meds steroids
porn xxx sex adult nude escorts webcam hookup
ads adserver advertising banner popup tracker clickbait affiliate
spam phishing malware spyware warez keygen scam hoax
loans payday forex replica counterfeit
""".split()
WANTED = """
library museum archive theatre cinema gallery opera orchestra
university school college academy kindergarten
hospital clinic dentist health
weather news radio magazine journal newspaper
recipes kitchen bakery coffee restaurant
garden forest river mountain village harbour farm
physics chemistry biology geology astronomy mathematics medicine economics law history philosophy linguistics
music poetry painting photography literature architecture
football tennis cycling sailing chess hiking
railway airport travel hotel atlas
wiki dictionary encyclopedia documents software blog forum shop
""".split()
#: Words that stand beside either kind and say nothing.
BESIDE = ("", "best", "top", "online", "my", "world", "club", "point", "direct")
#: Ordinary names are also invented: two or three syllables of a consonant and a vowel, so
#: that an unknown name without a word of the unwanted kind counts as ordinary.
CONSONANTS, VOWELS = "bdfgklmnprstv", "aeiou"

BITS, LOW, HIGH = 15, 3, 5


def names() -> list[tuple[str, int]]:
    """Host names and their label, 1 if unwanted: every word by itself and with each word
    that says nothing, before or after it, and invented names."""
    found = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for k, word in enumerate(words):
            for i, other in enumerate(BESIDE):
                found.append(("-".join(w for w in ((other, word) if (i + k) % 2 else (word, other)) if w), label))
    syllables = [c + v for c in CONSONANTS for v in VOWELS]
    n = len(syllables)
    for i in range(4 * n):
        found.append((syllables[i % n] + syllables[(7 * i + 3) % n] + (syllables[(11 * i + 5) % n] if i % 2 else ""), 0))
    return found


def training_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): the labelled table, names() under the endings kept for
    examples and common first labels, with one path of the same few for either class.
    Some 1,300 rows."""
    ends, firsts, paths = ("example.com", "example.net", "example.org"), ("", "www.", "blog.", "m."), ("/", "/index.html", "/en/1", "/de/22.html", "/fr/333/", "/es/4444", "/news/2024/05")
    return [(f"{firsts[k % 4]}{name}.{ends[k % 3]}", paths[k % 7], label) for k, (name, label) in enumerate(names())]


def grams(host: str, path: str) -> list[int]:
    """Buckets of the distinct character n-grams of the host (from `^` to `$`) and of
    the path, kept apart."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"{path.lower()}$")):
        for n in range(LOW, HIGH + 1):
            found.update(kind + text[i : i + n] for i in range(len(text) - n + 1))
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) >> 5 & (1 << BITS) - 1 for g in found})


def train(rows: Sequence[tuple[str, str, int]], rounds: int = 300, rate: float = 2.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept; full-batch
    gradient steps with classes weighted alike. Deterministic."""
    features = [grams(h, p) for h, p, _ in rows]
    y = np.array([label for _, _, label in rows], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    at = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    bucket = np.concatenate([np.array(f, int) for f in features])
    scale = 1 / np.sqrt([max(1, len(f)) for f in features])
    w = np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        z = np.bincount(at, w[bucket], len(rows)) * scale + w[-1]
        miss = share * (1 / (1 + np.exp(-z)) - y)
        w[:-1] -= rate * 8 * (np.bincount(bucket, (miss * scale)[at], 1 << BITS) + penalty * w[:-1])
        w[-1] -= rate * miss.sum()
    return w


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
    Path: from there up to `?`, `#` or the end. Both empty if null or without `://`."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does. A rule
    fits its host and all subdomains where the path starts with the rule's; of equal
    lengths the first in the alphabet wins, of equal ones with both verdicts allow."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, score, verdict): each URL judged.

    The verdict is that of the longest rule that fits; else `block` where the
    regression's probability of an unwanted URL is at least threshold, and `allow`
    below it. An empty host and path give no evidence: score 0, hence `allow`. Rows come out as
    they went in, repeated ones too, null keys kept; other columns are left out. No
    shuffle; the weights (2^15 + 1 numbers) go with the tasks, and each batch scores
    an URL that it holds several times once."""
    rows = narrow(df, key=key, url=url)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("key", host.alias("host"), path.alias("path"))
    weights = df.sparkSession.sparkContext.broadcast(train(training_table() if labelled is None else labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            known: dict[tuple[str, str], float] = {}
            out = []
            for pair in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if (s := known.get(pair)) is None:
                    f = grams(*pair)
                    known[pair] = s = float(1 / (1 + np.exp(-(w[f].sum() / max(1, len(f)) ** 0.5 + w[-1])))) if pair != ("", "") else 0.0
                out.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"key {kind}, host string, path string, score double")
    scored = scored.withColumn("fit", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), "score", verdict.alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the contract's rules and the trained model."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
