"""Toxicity by weak supervision.

Voters fire or keep quiet. *Lexicon voters* hold words: lists of common insults by language, and words mined
from a bounded sample of labelled texts that stand mostly in toxic ones. *Pattern voters* hold word
beginnings (which catch invented and inflected forms), words and beginnings that a text repeats, and shapes
of writing: letters replaced by stars, shouting, runs of exclamation marks.

A generative label model says for each class how often a voter fires given what one other voter does: the
voters are a tree of dependencies, that of the greatest conditional mutual information, so accuracies and
correlations are both estimated. It is fitted by expectation maximisation over the votes of every document,
grouped by pattern of votes; the labelled sample gives its start and stays in as prior counts. Whoever gave
the labels is one more voter whose accuracy is estimated. The posteriors for the sampled texts train a linear classifier over hashed words, beginnings and their repeats,
which scores every text: voters are for training only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.ftrl import fit, held_out, hash_of, sample_ids, sigmoid
from gazette.llm.textvec import ALNUM, U64, gathered, lower_latin, mix, slices, span_hashes, tidy, utf8, word_spans, written

#: Bytes of a word's beginning that make a pattern; occurrences of a mark that count as marks of their own.
BEGINNINGS, LEVELS = (4, 5, 6, 7), (1, 2, 3)
#: Half the number of labelled texts taken of each class at most.
SAMPLE = 1000
#: Voters among which mined words, beginnings and repeats are dealt, each.
DEALT = 8
#: Log-likelihood ratio of label and presence that a mark needs: chance gives no mark of a large sample as much.
EVIDENCE = 24.0
THRESHOLD = 0.7
#: Rounds of expectation maximisation at most: classes that the votes alone tell apart drift away from the labels in many.
ROUNDS = 4

#: Common insults, a list for each language: the lexicons that need no labels.
LEXICONS = {
    "en": "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown bastard bitch jerk imbecile filth vermin freak creep crap",
    "de": "idiot trottel dumm dummkopf arschloch abschaum wertlos erbärmlich ekelhaft widerlich versager dreckskerl schwein depp miststück",
    "fr": "idiot imbécile stupide crétin con connard salaud ordure minable pathétique dégoûtant nul débile raclure abruti",
    "es": "idiota imbécil estúpido estúpida tonto basura patético inútil asqueroso payaso escoria perdedor cabrón pendejo maldito",
}
_SHAPES = ("stars", "shouting", "exclaiming")
_SALT = np.array([0, 0, 0x6C62272E07BB0142, 0x27D4EB2F165667C5], U64)


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of beginnings of longer words, and their rows."""
    starts, ends = word_spans(data, offsets, ALNUM)
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes, rows = [span_hashes(data, starts, ends)], [row]
    for n in BEGINNINGS:
        longer = ends - starts > n
        begin = starts[longer]
        hashes.append(mix(span_hashes(data, begin, begin + n) + U64(n)))
        rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


def levelled(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A text's marks with those that its counts add: a key for each mark and level that is reached."""
    return np.concatenate([mix(hashes[counts >= k] + _SALT[k]) for k in LEVELS])


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: letters around a star; more than half of twenty or more ASCII letters in upper case; three exclamation marks in a row."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, len(_SHAPES)), bool)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letter, star, mark = upper | lower, data == 0x2A, data == 0x21
    found = np.zeros((3, len(data)), np.int64)
    if len(data) > 2:
        found[0, 2:] = letter[:-2] & star[1:-1] & letter[2:]
        found[1, 2:] = mark[:-2] & mark[1:-1] & mark[2:]
    # Three bytes that end in a row's first two began in another row.
    for k in (0, 1):
        edge = offsets[:-1] + k
        found[:2, edge[edge < len(data)]] = 0
    found[2] = letter
    sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (*found, upper)]
    stars, marks_, letters, uppers = (np.diff(s) for s in sums)
    return np.stack([stars > 0, (letters >= 20) & (2 * uppers > letters), marks_ > 0], 1)


def evidence(c1: np.ndarray, c0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of a mark's counts in n1 toxic and n0 other texts against equal shares."""
    share, term = (c1 + c0) / (n1 + n0), lambda c, n, q: c * np.log(np.maximum(c, 1e-9) / np.maximum(n * q, 1e-9))
    return 2 * (term(c1, n1, share) + term(c0, n0, share) + term(n1 - c1, n1, 1 - share) + term(n0 - c0, n0, 1 - share))


@dataclass
class Marked:
    """Entries (hash of a mark, occurrences that it takes, value), sorted by hash."""

    hashes: np.ndarray
    levels: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes, levels, values) -> Marked:
        order = np.argsort(hashes, kind="stable")
        out = cls(hashes[order], levels[order], values[order])
        out.bloom = np.zeros(1 << 16, bool)
        out.bloom[(hashes & U64(0xFFFF)).astype(np.int64)] = True
        return out

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and entries whose mark the row has often enough, each pair once."""
        maybe = np.flatnonzero(self.bloom[(hashes & U64(0xFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, hashes[maybe], "left")
        true = lo < len(self.hashes)
        true[true] = self.hashes[lo[true]] == hashes[maybe][true]
        pairs, counts = np.unique(rows[maybe][true] * (len(self.hashes) + 1) + lo[true], return_counts=True)
        row, lo = pairs // (len(self.hashes) + 1), pairs % (len(self.hashes) + 1)
        sizes = np.searchsorted(self.hashes, self.hashes[lo], "right") - lo
        entry, row, counts = gathered(lo, sizes), np.repeat(row, sizes), np.repeat(counts, sizes)
        enough = counts >= self.levels[entry]
        return row[enough], entry[enough]


class Keys:
    """All marks of a sample with their levels: (hash, level) of each key, and which keys each text has."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sets = [levelled(h, c) for h, c in texts]
        hashes = np.unique(np.concatenate([h for h, _ in texts])) if texts else np.zeros(0, U64)
        keys = np.concatenate([mix(hashes + _SALT[k]) for k in LEVELS])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.hashes = np.tile(hashes, len(LEVELS))[order]
        self.levels = np.repeat(np.array(LEVELS), len(hashes))[order]

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of the texts that have each key."""
        if not self.sets:
            return np.zeros(0)
        return np.bincount(np.searchsorted(self.keys, np.concatenate(self.sets)), np.repeat(weights, list(map(len, self.sets))), len(self.keys))


class Voters:
    """Named voters: mined marks and lexicons by their hashes, then the shapes."""

    def __init__(self, table: Marked, names: list[str]) -> None:
        self.table, self.names = table, [*names, *_SHAPES]

    @classmethod
    def mine(cls, keys: Keys, labels: np.ndarray) -> Voters:
        """Every mark with enough evidence and six times as frequent in toxic texts, dealt by rank among the voters of its kind."""
        hashes, levels, voter, names = [], [], [], [f"lexicon {k}" for k in LEXICONS]
        for n, words in enumerate(LEXICONS.values()):
            data, offsets = utf8(pa.array(words.split()))
            own = span_hashes(data, offsets[:-1], offsets[1:])
            hashes, levels, voter = [*hashes, own], [*levels, np.ones(len(own), np.int64)], [*voter, np.full(len(own), n)]
        n1, n0 = labels.sum(), (~labels).sum()
        c1, c0 = keys.counts(labels.astype(float)), keys.counts((~labels).astype(float))
        said = evidence(c1, c0, n1, n0)
        good = np.flatnonzero((said > EVIDENCE) & ((c1 + 0.1) / (n1 + 1) > 6 * (c0 + 0.5) / (n0 + 1)))
        good = good[np.lexsort((keys.keys[good], -said[good]))]
        for kind, chosen in (("once", keys.levels[good] == 1), ("twice", keys.levels[good] == 2), ("often", keys.levels[good] == 3)):
            own = good[chosen]
            if len(own):
                hashes, levels = [*hashes, keys.hashes[own]], [*levels, keys.levels[own]]
                voter = [*voter, len(names) + np.arange(len(own)) % DEALT]
                names += [f"{kind} {k}" for k in range(min(DEALT, len(own)))]
        return cls(Marked.of(*map(np.concatenate, (hashes, levels, voter))), names)

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A number per text whose bits say which voters fire."""
        out = np.zeros(len(offsets) - 1, np.int64)
        row, entry = self.table.hits(*marks(lower_latin(data), offsets))
        np.bitwise_or.at(out, row, np.int64(1) << self.table.values[entry])
        shaped = shapes(data, offsets) @ (np.int64(1) << np.arange(len(_SHAPES)))
        return out | shaped << (len(self.names) - len(_SHAPES))


def unpacked(bits: np.ndarray, voters: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(voters) & 1).astype(bool)


@dataclass
class Counts:
    """Weight of texts, of those in which a voter fires, and in which two fire, by class."""

    texts: np.ndarray
    fired: np.ndarray
    both: np.ndarray

    @classmethod
    def of(cls, votes: np.ndarray, weights: np.ndarray, toxic: np.ndarray) -> Counts:
        each = np.stack([weights * (1 - toxic), weights * toxic])
        return cls(each.sum(1), each @ votes, np.stack([(votes * w[:, None]).T @ votes.astype(float) for w in each]))

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.texts + other.texts, self.fired + other.fired, self.both + other.both)

    def scaled(self, texts: np.ndarray) -> Counts:
        """The same rates with so many texts in each class."""
        by = texts / np.maximum(self.texts, 1e-9)
        return Counts(texts, self.fired * by[:, None], self.both * by[:, None, None])

    def pack(self) -> bytes:
        return np.concatenate([self.texts, self.fired.ravel(), self.both.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, voters: int) -> Counts:
        x = np.frombuffer(raw)
        return cls(x[:2], x[2 : 2 + 2 * voters].reshape(2, voters), x[2 + 2 * voters :].reshape(2, voters, voters))


class LabelModel:
    """Two classes; in each a voter fires by a rate that depends on what its parent in a tree of voters does."""

    def __init__(self, prior: float, parent: np.ndarray, rates: np.ndarray) -> None:
        #: rates[class, voter, whether the parent fires]; the root has both alike.
        self.prior, self.parent, self.rates = prior, parent, rates

    @classmethod
    def of(cls, counts: Counts, prior: float) -> LabelModel:
        """The maximum of the likelihood, each rate with half a text more on either side."""
        parent = tree(counts)
        n, fired, both = counts.texts[:, None], counts.fired, counts.both
        beside = np.stack([both[y][np.arange(len(parent)), parent] for y in (0, 1)])
        rates = np.stack([(fired - beside + 0.5) / (n - fired[:, parent] + 1), (beside + 0.5) / (fired[:, parent] + 1)], 2)
        root = parent == np.arange(len(parent))
        rates[:, root] = ((fired[:, root] + 0.5) / (n + 1))[:, :, None]
        return cls(float(np.clip(prior, 1e-4, 1 - 1e-4)), parent, np.clip(rates, 1e-4, 1 - 1e-4))

    @classmethod
    def fit(cls, known: Counts, expect: Callable[[LabelModel], Counts], rounds: int = ROUNDS) -> LabelModel:
        """``known`` are the labelled texts' counts: the start, and half of the evidence on each class in every round, however many
        other texts there are (else the classes drift to what splits the votes best). ``expect`` gives all texts' expected counts."""
        model = cls.of(known, known.texts[1] / known.texts.sum())
        for _ in range(rounds):
            found = expect(model)
            step = cls.of(known + found.scaled(known.texts), found.texts[1] / max(found.texts.sum(), 1e-9))
            moved = abs(step.prior - model.prior) + np.abs(step.rates - model.rates).max()
            model = step
            if moved < 1e-3:
                break
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each row of votes."""
        above = votes[:, self.parent].astype(int)
        said = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for v in range(votes.shape[1]):
            fires, quiet = np.log(self.rates[1, v] / self.rates[0, v]), np.log((1 - self.rates[1, v]) / (1 - self.rates[0, v]))
            said += np.where(votes[:, v], fires[above[:, v]], quiet[above[:, v]])
        return sigmoid(said)

    def informed(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The same where a text has a label: whoever labelled is one more voter, as accurate as the other voters' posteriors say."""
        seen = self.posterior(votes)
        given = [((w * labels).sum() + 0.5) / (w.sum() + 1) for w in (1 - seen, seen)]
        said = np.where(labels, np.log(given[1] / given[0]), np.log((1 - given[1]) / (1 - given[0])))
        return sigmoid(np.log(np.clip(seen, 1e-9, 1)) - np.log(np.clip(1 - seen, 1e-9, 1)) + said)


def tree(counts: Counts) -> np.ndarray:
    """Each voter's parent in the spanning tree of the greatest mutual information given the class; the root is its own."""
    voters = counts.fired.shape[1]
    total = counts.texts.sum() + 1e-9
    info = np.zeros((voters, voters))
    for n, fired, both in zip(counts.texts, counts.fired, counts.both, strict=True):
        n = n + 1e-9
        for joint, a, b in ((both, fired, fired), (fired[:, None] - both, fired, n - fired), (fired[None] - both, n - fired, fired), (n - fired[:, None] - fired[None] + both, n - fired, n - fired)):
            joint, expected = np.maximum(joint, 0), np.outer(np.maximum(a, 0), np.maximum(b, 0)) / n
            info += joint / total * np.log(np.maximum(joint, 1e-12) / np.maximum(expected, 1e-12))
    parent, nearest, best = np.zeros(voters, np.int64), np.zeros(voters, np.int64), info[0].copy()
    joined = np.zeros(voters, bool)
    joined[0] = True
    for _ in range(voters - 1):
        v = int(np.where(joined, -np.inf, best).argmax())
        parent[v], joined[v] = nearest[v], True
        closer = ~joined & (info[v] > best)
        nearest[closer], best[closer] = v, info[v][closer]
    return parent


def vote_patterns(docs: DataFrame, voters: Voters) -> DataFrame:
    """(votes, texts): how many of all documents vote alike, counted within each batch first."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                votes, texts = np.unique(sent.value.votes(data[o[0] : o[-1]], o - o[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(texts)], names=["votes", "texts"])

    counted = docs.select("text").mapInArrow(tidy(run), "votes long, texts long").groupBy("votes").agg(F.sum("texts").alias("texts"))
    return written(counted, "vote-patterns")


def expected(patterns: DataFrame, voters: int) -> Callable[[LabelModel], Counts]:
    """The expectation over a table of vote patterns: sums within each task, then over tasks."""

    def step(model: LabelModel) -> Counts:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                votes = unpacked(batch.column(0).to_numpy(), voters)
                part = Counts.of(votes, batch.column(1).to_numpy().astype(float), model.posterior(votes))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["sums"])

        found = [Counts.unpack(r.sums, voters) for r in patterns.mapInArrow(run, "sums binary").toLocalIterator()]
        return sum(found[1:], found[0]) if found else Counts(np.zeros(2), np.zeros((2, voters)), np.zeros((2, voters, voters)))

    return step


class Classifier:
    """Weights of marks and their levels; every other mark weighs nothing."""

    def __init__(self, table: Marked | None, constant: float) -> None:
        self.table, self.constant = table, constant

    @classmethod
    def fit(cls, keys: Keys, targets: np.ndarray) -> Classifier:
        """Targets are posteriors. Keys take part whose presence says much of them (evidence as for voters)."""
        total, toxic = keys.counts(np.ones(len(targets))), keys.counts(targets)
        chosen = np.flatnonzero(evidence(toxic, total - toxic, targets.sum(), (1 - targets).sum()) > EVIDENCE)
        rows = []
        for s, y in zip(keys.sets, targets, strict=True):
            own = np.flatnonzero(np.isin(keys.keys[chosen], s)) + 1
            rows.append((own, np.ones(len(own)), float(y)))
        weights = fit(rows, len(chosen) + 1, epochs=20, alpha=0.2, l1=0.3, l2=0.05)
        kept = np.flatnonzero(weights[1:])
        return cls(Marked.of(keys.hashes[chosen[kept]], keys.levels[chosen[kept]], weights[1:][kept]), float(weights[0]))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each row's score from its marks."""
        rows = len(offsets) - 1
        if self.table is None or not len(self.table.hashes):
            return np.full(rows, sigmoid(np.array(self.constant)))
        row, entry = self.table.hits(*marks(lower_latin(data), offsets))
        return sigmoid(np.bincount(row, self.table.values[entry], rows) + self.constant)


def collect(docs: DataFrame, labels: DataFrame, size: int) -> list[tuple[float, np.ndarray, np.ndarray, str]]:
    """(label, marks, their counts up to the last level, text's votes-free bytes) of the sampled texts in a fixed order, one text for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                hashes, row = marks(lower_latin(data[o[0] : o[-1]]), o - o[0])
                packed = []
                for k in range(b - a):
                    own, n = np.unique(hashes[row == k], return_counts=True)
                    packed.append(own.tobytes() + np.minimum(n, LEVELS[-1]).astype(np.uint8).tobytes())
                shape = shapes(data[o[0] : o[-1]], o - o[0]) @ (1 << np.arange(len(_SHAPES)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(packed, pa.binary()), pa.array(shape, pa.int64())], names=["doc_id", "label", "marks", "shape"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(sample_ids(labels, "toxic", size)), "doc_id").select("doc_id", "text", "label")
    found = written(sampled.mapInArrow(tidy(run), "doc_id long, label int, marks binary, shape long"), "toxic-sample")
    rows = found.groupBy("doc_id", "label").agg(F.min(F.struct("marks", "shape")).alias("x")).select("doc_id", "label", "x.*").collect()
    rows.sort(key=lambda r: (hash_of(r.doc_id), r.label))
    out = []
    for r in rows:
        n = len(r.marks) // 9
        out.append((float(r.label), np.frombuffer(r.marks, U64, n), np.frombuffer(r.marks, np.uint8, n, 8 * n), r.shape))
    return out


def votes_of(voters: Voters, texts: list[tuple[np.ndarray, np.ndarray]], shape: np.ndarray) -> np.ndarray:
    """Votes of sampled texts, from their marks and counts."""
    rows = np.concatenate([np.repeat(k, int(c.sum())) for k, (_, c) in enumerate(texts)])
    hashes = np.concatenate([np.repeat(h, c) for h, c in texts])
    out = np.zeros(len(texts), np.int64)
    row, entry = voters.table.hits(hashes, rows)
    np.bitwise_or.at(out, row, np.int64(1) << voters.table.values[entry])
    return unpacked(out | shape << (len(voters.names) - len(_SHAPES)), len(voters.names))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Classifier:
    """The classifier; without labels of both classes it gives every text a score of about 0."""
    rows = collect(docs, labels, size)
    known = np.array([r[0] for r in rows]) == 1
    if known.all() or not known.any():
        return Classifier(None, -35.0)
    texts = [(r[1], r[2]) for r in rows]
    keys = Keys(texts)
    voters = Voters.mine(keys, known)
    votes = votes_of(voters, texts, np.array([r[3] for r in rows]))
    start = Counts.of(votes, np.ones(len(votes)), known.astype(float))
    model = LabelModel.fit(start, expected(vote_patterns(docs, voters), len(voters.names)))
    return Classifier.fit(keys, model.informed(votes, known))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, score of every whole text; null and empty texts have no marks and get the constant's score."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                scores = sent.value.score(data[o[0] : o[-1]], o - o[0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scores, pa.float64())], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double"), "toxicity")


def score_documents(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, learned from the labels that aren't held out.

    Null and empty texts get the score of a text without marks. Rows that repeat give rows that repeat; of
    rows that repeat a sampled id one takes part in training. A null doc_id stays null and counts as held
    out. An id with both labels takes part with each. Without labels of both classes (an empty table of
    labels) scores are about 0; an empty table of documents gives an empty result. Other columns are not read.
    """
    scored = score(docs, train(docs, labels, size))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
