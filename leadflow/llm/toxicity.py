"""Toxicity by weak supervision.

1. A bounded sample of labelled texts (``SAMPLE`` rows, those with the smallest
   hash of their id; held-out rows never) gives a lexicon: terms that are much
   more frequent in toxic texts. Terms are words and beginnings of words, A-Z
   in lower case, with digits and signs that stand in for letters read as those,
   and each of them once more where it makes up a ``DENSE``-th of a text's words:
   a stem that clean texts hold now and then tells much if a text is full of it.
2. Voters: the lexicon dealt out by kind of term and by a hash, so that no voter
   sees all of it, each for one and for several different hits, and pattern
   voters on shouting and piled-up punctuation. A voter says +1, -1 or 0.
3. A generative label model. Given the true label, voters are taken to be
   independent but for correlations it finds: accuracies come from the
   covariances of triplets of voters, without labels; what a pair's covariance
   has beyond that is its correlation. The posterior weighs voters by the
   inverse of that within-class covariance.
4. A linear classifier on the terms' presence is trained on the posteriors and
   scores every whole text in one pass.

The sample takes both classes apart, so a rare one is seen as well; the scores
are put right by the shares that were taken. Only the vote sums, the lexicon
(``TERMS`` rows at most) and the sample's term lists (bounded by ``SAMPLE``)
reach the driver.

Defined results: null or empty text has no terms and gets the classifier's
value for that; a null doc_id is scored, never learned from and not held out;
several labels of one row count as toxic if any is; rows without a label are
scored only; without both kinds of labels every score is the share of toxic
ones (0 without any); other columns are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import materialize, prepare, table

#: Most labelled rows that anything is learned from.
SAMPLE = 30_000
#: Most terms that are counted; and that the classifier weighs.
TERMS = 100_000
WEIGHED = 4_096
#: A lexicon term stands in this many toxic texts; its log odds there are higher
#: by ``LIKELY``, and by ``LOG_ODDS`` less ``DOUBT`` standard errors.
SUPPORT, LIKELY, LOG_ODDS, DOUBT = 5, 4.5, 2.5, 1.64
#: The last bound for a term of the classifier, either way.
CLEAR = 1.0
#: A term is dense in a text if one word of so many has it.
DENSE = 100
#: Bytes of the beginnings of words that are terms besides the words.
BEGINNINGS = (4, 5, 6)
GROUPS = 3
FOLDS = 5

_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[0x80:] = True
_READ = T.LOWER.copy()
for _sign, _as in zip(b"013457@$", b"oieastas"):
    _READ[_sign] = _as
#: Kinds of terms: words, their beginnings, and the same again where dense.
KINDS = 2 * (1 + len(BEGINNINGS))
_DENSE = np.uint64(0xD1B54A32D192ED03)
_KIND = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, 2 + len(BEGINNINGS))]


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, kind) of all terms of a batch of texts; kind 0: the word itself."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    read = _READ[buf]
    letter = _LETTER[read]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | first[1:n]
    end[:-1] &= ~letter[1:] | first[1:n]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets, a, "right") - 1
    prefix = T.prefix_hash(read)
    hashes, rows, kinds = [T.span_hash(prefix, a, b) ^ _KIND[0]], [row], [np.zeros(len(a), np.int8)]
    for k, size in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(b - a > size)
        s = a[longer]
        hashes.append(T.span_hash(prefix, s, s + size) ^ _KIND[k])
        rows.append(row[longer])
        kinds.append(np.full(len(s), k, np.int8))
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(kinds)


def text_terms(buf: np.ndarray, offsets: np.ndarray, wanted: "Lookup | None" = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, kind) of the terms of a batch of texts, each once per text, dense ones
    once more under a hash and kind of their own; with ``wanted``, those it may hold."""
    h, row, kind = terms(buf, offsets)
    words = np.bincount(row[kind == 0], minlength=len(offsets) - 1)
    if wanted is not None:
        some = np.flatnonzero(wanted.plain.find(h) >= 0)
        h, row, kind = h[some], row[some], kind[some]
    order = np.lexsort((h, row))
    h, row, kind = h[order], row[order], kind[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(h)))
    h, row, kind = h[at], row[at], kind[at]
    d = times * DENSE >= words[row]
    return (np.concatenate([h, h[d] ^ _DENSE]), np.concatenate([row, row[d]]),
            np.concatenate([kind, kind[d] + np.int8(KINDS // 2)]))


def distinct_terms(buf: np.ndarray, offsets: np.ndarray, wanted: "Lookup") -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the term in ``wanted``), each once per text, by row."""
    hashes, rows, _ = text_terms(buf, offsets, wanted)
    at = wanted.find(hashes)
    seen = at >= 0
    both = np.unique(rows[seen] * len(wanted.keys) + at[seen]) if seen.any() else np.zeros(0, np.int64)
    return both // max(1, len(wanted.keys)), both % max(1, len(wanted.keys))


class Lookup:
    """Numbers of the terms of a sorted list; most others are turned away by a bitmap."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    @cached_property
    def plain(self) -> "Lookup":
        """The terms themselves, whether asked for as they are or where dense."""
        return Lookup(np.union1d(self.keys, self.keys ^ _DENSE))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return out
        may = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == hashes[may], at, -1)
        return out


def pattern_votes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters per text: shouting, and piled-up punctuation."""
    n = len(offsets) - 1
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    lower = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
    sign = (buf == ord("!")) | (buf == ord("?")) | (buf == ord("*"))
    pile = np.zeros(len(buf), bool)
    pile[1:] = sign[1:] & sign[:-1]
    piles = np.concatenate([[0], np.cumsum(pile)])
    a, b = offsets[:-1], offsets[1:]
    up, low, piled = upper[b] - upper[a], lower[b] - lower[a], piles[b] - piles[a]
    votes = np.zeros((n, 2), np.int8)
    votes[:, 0] = np.where(up + low < 20, 0, np.where(up > 0.5 * (up + low), 1, -1))
    votes[:, 1] = np.where(b == a, 0, np.where(piled > 0, 1, -1))
    return votes


@dataclass
class Voters:
    """The lexicon's terms, dealt to voters by kind and hash."""
    keys: np.ndarray      # sorted hashes
    voter: np.ndarray     # the lexicon voter that a term belongs to

    COUNT = KINDS * GROUPS

    def votes(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, term = distinct_terms(buf, offsets, Lookup(self.keys))
        hits = np.zeros((n, self.COUNT), np.int64)
        np.add.at(hits, (row, self.voter[term]), 1)
        # the lexicon of one language finds nothing in the texts of another, so
        # silence is a vote only where no voter finds anything
        silent = -((np.diff(offsets)[:, None] > 0) & ~hits.any(axis=1, keepdims=True)).astype(np.int64)
        one = np.where(hits > 0, 1, silent)
        more = np.where(hits > 2, 1, np.where(hits > 0, 0, silent))
        return np.concatenate([one, more, pattern_votes(buf, offsets)], axis=1).astype(np.int8)


@dataclass
class LabelModel:
    hit: np.ndarray            # P(a voter says +1 | toxic), P(it does | clean): two rows
    trust: np.ndarray          # what its evidence counts, 1 for a voter that stands alone
    prior: float
    correlation: np.ndarray    # of each pair of voters, given the label

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        says = np.log(self.hit[0] / self.hit[1]) * self.trust
        silent = np.log((1 - self.hit[0]) / (1 - self.hit[1])) * self.trust
        z = self.prior + (votes > 0) @ says + (votes < 0) @ silent
        # of the voters that say +1, the most telling one counts in full
        full = np.where(votes > 0, np.log(self.hit[0] / self.hit[1]), 0.0)
        top = np.argmax(full, axis=1)
        z += full[np.arange(len(votes)), top] * (1 - self.trust[top])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(mean: np.ndarray, second: np.ndarray, share: float, rows: int) -> LabelModel:
    """From how often voters say +1, how often pairs do, and the share of the class.

    Voters independent given the label have the covariances of one factor:
    cov[i, j] = s[i] * s[j], where s[i] is the gap between the two classes'
    rates times the label's deviation. Each triplet gives one estimate of
    s[i]**2; the median stands up to correlated voters.
    """
    cov = second - np.outer(mean, mean)
    m = len(mean)
    live = np.flatnonzero(np.diag(cov) > 1e-6)
    s = np.zeros(m)
    for i in live:
        others = live[live != i]
        j, k = np.triu_indices(len(others), 1)
        j, k = others[j], others[k]
        solid = np.abs(cov[j, k]) > 1e-5
        if solid.any():
            found = cov[i, j[solid]] * cov[i, k[solid]] / cov[j[solid], k[solid]]
            s[i] = np.sqrt(np.clip(np.median(found), 0, cov[i, i]))
    if len(live):
        chief = live[int(np.argmax(s[live]))]
        s *= np.where(cov[:, chief] < 0, -1, 1)
    gap = s / np.sqrt(max(share * (1 - share), 1e-9))
    least = 1 / (rows + 2)
    clean = np.clip(mean - share * gap, least, 1 - least)
    toxic = np.clip(mean + (1 - share) * gap, least, 1 - least)
    left = cov - np.outer(s, s)
    own = np.sqrt(np.maximum(np.diag(left), 1e-6))
    correlation = np.clip(left / np.outer(own, own), -1, 1)
    np.fill_diagonal(correlation, 0)
    # voters that repeat each other share one voice
    strong = np.where(np.abs(correlation) >= 0.1, np.abs(correlation), 0)
    trust = 1 / (1 + strong.sum(axis=1))
    return LabelModel(np.array([toxic, clean]), trust, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), correlation)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, term = distinct_terms(buf, offsets, Lookup(self.keys))
        z = self.bias + np.bincount(row, self.weights[term], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_linear(row: np.ndarray, term: np.ndarray, target: np.ndarray, n_terms: int,
                 steps: int = 300, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; presence features given as (row, term) pairs."""
    w, b = np.zeros(n_terms), 0.0
    gw, gb = np.full(n_terms, 1e-8), 1e-8
    n = max(1, len(target))
    for _ in range(steps):
        z = b + np.bincount(row, w[term], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(term, e[row], minlength=n_terms) + decay * w
        gw += grad * grad
        gb += e.sum() ** 2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    return w, float(b)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[DataFrame, float]:
    """Stored (doc_id, text, toxic) of at most ``rows`` labelled rows to learn from, half
    of them toxic if there are as many; and by how much that raises the log odds of it."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    have = {r["bad"]: r["count"] for r in known.groupBy((F.col("toxic") != 0).alias("bad")).count().collect()}
    bad, good = have.get(True, 0), have.get(False, 0)
    take_bad = min(bad, max(rows // 2, rows - good))
    take_good = min(good, rows - take_bad)
    lift = math.log(take_bad / bad) - math.log(take_good / good) if take_bad and take_good else 0.0
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    some = (known.filter("toxic != 0").orderBy(*by_hash).limit(take_bad)
            .union(known.filter("toxic = 0").orderBy(*by_hash).limit(take_good)))
    # at most ``rows`` pairs of numbers are sent; copies of a text count once
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                       .join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
                       .withColumn("_h", F.md5("text")).dropDuplicates(["_h", "toxic"]).drop("_h"),
                       "toxicity-sample"), lift


def _term_counts(sample: DataFrame, toxic: bool, wanted: np.ndarray | None) -> DataFrame:
    """(term, kind, n): in how many texts of the class a term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None if wanted is None else Lookup(wanted)
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(0))
            for i, j in T.slices(offsets, 2 << 20):
                # once per text, then counted over the batch
                h, _, kind = text_terms(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], look)
                if look is not None:
                    some = look.find(h) >= 0
                    h, kind = h[some], kind[some]
                found, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(kind[at].astype(np.int32)), pa.array(n)],
                    ["term", "kind", "n"])

    return (sample.filter(F.col("toxic") == int(toxic)).select("text")
            .mapInArrow(T.tidy(run), "term long, kind int, n long").groupBy("term").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The whole learning part; see the module's text."""
    sample, lift = labelled_sample(docs, labels, rows)
    have = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).count().collect()}
    n_pos, n_neg = have.get(1, 0), have.get(0, 0)
    share = n_pos / max(1, n_pos + n_neg)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)) - lift))
    if not n_pos or not n_neg:
        return nothing
    # terms of toxic texts, the most frequent ones; then the same terms in the others
    top = (_term_counts(sample, True, None).filter(F.col("n") >= SUPPORT)
           .orderBy(F.desc("n"), "term").limit(TERMS).toPandas())
    keys = top["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, pos, kind = keys[order], top["n"].to_numpy()[order].astype(float), top["kind"].to_numpy()[order]
    if not len(keys):
        return nothing
    rest = _term_counts(sample, False, keys).toPandas()
    neg = np.zeros(len(keys))
    neg[np.searchsorted(keys, rest["term"].to_numpy(np.int64).view(np.uint64))] = rest["n"]
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    lexicon = (odds >= LIKELY) & (odds - DOUBT * error >= LOG_ODDS)
    if not lexicon.any():
        return nothing
    # the few dense terms of a kind stay together, so that their voter knows all languages
    voters = Voters(keys[lexicon], kind[lexicon] * GROUPS + np.where(
        kind[lexicon] < KINDS // 2, (T.mix(keys[lexicon]) % np.uint64(GROUPS)).astype(np.int64), 0))
    # terms that tell the classes apart beyond doubt, the clearest ones first
    clear = np.abs(odds) - DOUBT * error
    weighed = np.argsort(-clear, kind="stable")[:WEIGHED]
    weighed = np.sort(weighed[clear[weighed] >= CLEAR])
    weighed_keys = keys[weighed]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(weighed_keys)
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(0))
            for i, j in T.slices(offsets, 2 << 20):
                own, at = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                votes = voters.votes(own, at)
                row, term = distinct_terms(own, at, look)
                upto = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes() for v in votes], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(upto), pa.array(term.astype(np.int32)))], ["votes", "terms"])

    # one short row per sampled text: its votes and its terms among WEIGHED
    seen = sample.select("text").mapInArrow(T.tidy(vote), "votes binary, terms array<int>").toArrow()
    votes = np.array([np.frombuffer(v, np.int8) for v in seen["votes"].to_pylist()]).astype(float)
    lists = seen["terms"].combine_chunks()
    hits = (votes > 0).astype(float)
    model = fit_label_model(hits.mean(axis=0), hits.T @ hits / len(hits), share, len(hits))
    size = np.diff(lists.offsets.to_numpy())
    weights, bias = train_linear(np.repeat(np.arange(len(size)), size), lists.values.to_numpy(),
                                 model.posterior(votes), len(weighed_keys))
    return Model(weighed_keys, weights, bias - lift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with score and predicted added."""
    clash = {"score", "predicted"} & set(docs.columns)
    if clash:
        raise ValueError(f"scored() adds columns that are there already: {sorted(clash)}")
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(at_text))
            score = np.zeros(batch.num_rows)
            for i, j in T.slices(offsets, 2 << 20):
                score[i:j] = model.scores(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [*names, "score", "predicted"])

    from pyspark.sql.types import StructType
    schema = StructType(list(docs.schema)).add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(T.tidy(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    # score and predicted are looked at under names of their own, whatever docs holds
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"_c{i}") for i, c in enumerate(names)])
    kept = scored(plain, fit(docs, labels)).filter("predicted = 0")
    return kept.select(*[F.col(c if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(names)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
