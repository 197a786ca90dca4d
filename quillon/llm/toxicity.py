"""Toxicity by a weighted finite-state pattern grammar whose lexicon arcs are learnt.

Words become classes (insult, threat, target, negation, report, other); insults and threats
carry an arc weight.  The arcs are learnt: of the whole words and the stems of four to eight
characters in the labelled training texts, those stay whose log odds of a toxic text are
above ``LEAST_ODDS`` at the lower end of their confidence interval, which is their weight.
The hand list is a prior: its words have a fixed weight until the labels give a larger one.

A text's clauses are read by the product of small transducers: one remembers a recent
negation, one reported speech, one a recent target; a second target machine reads the clause
backwards.  A clause's path adds up the weights of its triggers, and comes out as one event:
the kind of its strongest trigger (a threat, or an insult of one of four path weights),
targeted or not, plain / negated / reported.  A text is scored by a logistic over the counts
of its events, the share of its clauses that match and the path weight for each word; the
coefficients start from the prior below and are moved by labelled rows (MAP logistic
regression).  Each half of the labelled rows is read with arcs of the other half for that, so
that no text vouches for its own words; the arcs in use are of both halves.

Arcs and coefficients are learnt from a bounded sample of labelled rows (``TRAIN_ROWS``).
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .textkit import Words, blocks, mix, word_hash

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

LEXICON = {
    INSULT: """
        idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles cretin loser losers
        pathetic worthless scum scumbag trash garbage filth filthy vermin clown clowns fool fools foolish jerk
        jerks bastard bastards bitch bitches asshole assholes dickhead prick disgusting repulsive subhuman
        degenerate degenerates parasite parasites retard retarded freak freaks creep creeps pig pigs swine
        dummkopf arschloch vollidiot trottel depp abschaum dreckskerl widerlich
        connard connasse salaud crétin abruti débile ordure minable
        imbécil estúpido estúpida gilipollas cabrón escoria basura asqueroso asquerosa
    """,
    THREAT: """
        kill murder hurt destroy stab shoot strangle lynch exterminate
        töten umbringen tuer tuerai matar mataré
    """,
    TARGET: """
        you your yours yourself you're youre u ur he him his she her they them their those these people
        everyone everybody dich dir du euch ihr tu te toi vous ton tes tú usted ustedes
    """,
    NEGATION: """
        not never no isn't aren't wasn't don't doesn't didn't ain't nobody neither nor without
        nicht kein keine nie pas jamais nunca jamás
    """,
    REPORT: """
        said says say saying called calls wrote writes quoted quote claimed claims alleged reportedly accused
        sagte sagten schrieb dit disait écrit dijo decía escribió
    """,
}

#: how many words a negation or a target reaches
NEGATION_REACH, TARGET_REACH = 3, 4
#: lower ends of the path weights of insult1 to insult4
TIERS = (0.0, 2.0, 4.0, 8.0)
KINDS = ("insult1", "insult2", "insult3", "insult4", "threat")
EVENTS = list(product(KINDS, (0, 1), ("plain", "negated", "reported")))
#: weight of a listed word that the labels say nothing about; what negation or report leave of a weight
LISTED, THREATENS, LEFT = 4.0, 1.0, 0.2
#: labelled rows to learn from; stems; texts and share of the toxic ones that an arc needs; its least log odds
TRAIN_ROWS, STEMS, ARC_TEXTS, ARC_SHARE, LEAST_ODDS = 40_000, range(4, 9), 4, 0.004, 0.7
PRIOR_BIAS = -3.5


def prior_weight(event) -> float:
    kind, targeted, how = event
    w = {"insult1": 0.5, "insult2": 1.0, "insult3": 4.0, "insult4": 5.0, "threat": 1.0}[kind]
    w += (4.0 if kind == "threat" else 0.5) * targeted
    return w if how == "plain" else LEFT * w


#: of the bias, the events, the path weight for each word and the share of matched clauses
PRIOR_WEIGHTS = np.array([PRIOR_BIAS, *map(prior_weight, EVENTS), 1.0, 0.5])


class Transducer:
    """A deterministic transducer over word classes: (state, class) -> (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same word; states and outputs pair up."""

        def step(state, symbol):
            a, x = self.step(state[0], symbol)
            b, y = other.step(state[1], symbol)
            return (a, b), (*x, *y)

        return Transducer((self.start, other.start), step)

    def compiled(self):
        """Tables next[state][class] and out[state][class] over the states that can be reached."""
        index, todo, nexts, outs = {self.start: 0}, [self.start], [], []
        for state in todo:
            row, out = [], []
            for symbol in range(6):
                new, o = self.step(state, symbol)
                if new not in index:
                    index[new] = len(index)
                    todo.append(new)
                row.append(index[new])
                out.append(o)
            nexts.append(row)
            outs.append(out)
        return nexts, outs


def _recent(cls: int, reach: int) -> Transducer:
    """Says at each word whether ``cls`` stood among the last ``reach`` words."""

    def step(left, symbol):
        return (reach if symbol == cls else max(0, left - 1)), (int(left > 0),)

    return Transducer(0, step)


def _since(cls: int) -> Transducer:
    return Transducer(0, lambda seen, symbol: (int(seen or symbol == cls), (seen,)))


FORWARD = _recent(NEGATION, NEGATION_REACH).compose(_since(REPORT)).compose(_recent(TARGET, TARGET_REACH)).compiled()
BACKWARD = _recent(TARGET, TARGET_REACH).compiled()
_EVENT_AT = {e: i for i, e in enumerate(EVENTS)}
#: arc weight of a class by itself; learnt arcs have their own
_BY_CLASS = {INSULT: LISTED, THREAT: THREATENS}


def _run(machine, codes):
    nexts, outs = machine
    state, got = 0, []
    for c in codes:
        got.append(outs[state][c])
        state = nexts[state][c]
    return got


def clause_path(codes: list[int], weights: list[float] | None = None) -> tuple[int, float]:
    """The event of one clause that has a trigger, and the weight of its path."""
    ahead, back = _run(FORWARD, codes), _run(BACKWARD, codes[::-1])[::-1]
    total, best = 0.0, (-1.0, None, "", 0)
    for i, (c, (negated, reported, before), (after,)) in enumerate(zip(codes, ahead, back, strict=True)):
        if c in _BY_CLASS:
            how = "reported" if reported else "negated" if negated else "plain"
            w = (_BY_CLASS[c] if weights is None else weights[i]) * (1.0 if how == "plain" else LEFT)
            total += w
            best = max(best, (w, "threat" if c == THREAT else "insult", how, int(before or after)), key=lambda x: x[0])
    _, kind, how, targeted = best
    if kind == "insult":
        whole = total if how == "plain" else total / LEFT
        kind += str(sum(whole >= t for t in TIERS))
    return _EVENT_AT[kind, targeted, how], total


_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x27]] = False
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?;:\n"]] = 1
_SCREEN = np.uint64((1 << 20) - 1)


def whole_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of whole words, other than those of stems."""
    return mix(hashes, 41)


def stem_keys(w: Words):
    """(words, keys) for each length of stem: the words that are as long, and the hashes of their first characters."""
    begins = (w.buf & 0xC0) != 0x80
    char = np.flatnonzero(begins)
    rank = np.cumsum(begins)[w.start] - 1
    for k in STEMS:
        end = np.append(char, len(w.buf))[np.minimum(rank + k, len(char))]
        long = np.flatnonzero(end <= w.end)
        yield long, w.span_hash(w.start[long], end[long])


class Lexicon:
    """Classes of listed words and weights of learnt arcs, both by sorted key."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        codes = {word_hash(x): c for c, words in LEXICON.items() for x in words.split()}
        self.listed = np.array(sorted(codes), np.uint64)
        self.classes = np.array([codes[int(k)] for k in self.listed], np.int8)
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.listed_screen, self.screen = (self._bits(x) for x in (self.listed, self.keys))

    @staticmethod
    def _bits(keys):
        out = np.zeros(1 << 20, bool)
        out[keys & _SCREEN] = True
        return out

    @staticmethod
    def _find(keys, screen, wanted):
        """(places in ``wanted``, places in ``keys``) of those that are there."""
        maybe = np.flatnonzero(screen[wanted & _SCREEN])
        at = np.minimum(np.searchsorted(keys, wanted[maybe]), max(0, len(keys) - 1))
        ok = keys[at] == wanted[maybe] if len(keys) else np.zeros(0, bool)
        return maybe[ok], at[ok]

    def read(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class and arc weight of each word."""
        codes, weights = np.zeros(len(w.hash), np.int8), np.zeros(len(w.hash))
        for words, keys in ((np.arange(len(w.hash)), whole_keys(w.hash)), *stem_keys(w)) if len(self.keys) else ():
            x, at = self._find(self.keys, self.screen, keys)
            np.maximum.at(weights, words[x], self.weights[at])
        codes[weights > 0] = INSULT
        x, at = self._find(self.listed, self.listed_screen, w.hash)
        cls = self.classes[at]
        # learnt insults stay insults; a listed trigger has its prior weight at least
        keep = (codes[x] == OTHER) | (cls == THREAT)
        codes[x[keep]] = cls[keep]
        weights[x] = np.where((cls == INSULT) | (cls == THREAT), np.maximum(weights[x], np.where(cls == THREAT, THREATENS, LISTED)), weights[x])
        return codes, weights


class Events:
    """Of each text: counts by event, clauses that match, clauses, words and the weight of all paths."""

    def __init__(self, n: int):
        self.counts, self.clauses, self.words, self.weight = np.zeros((n, len(EVENTS)), np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)

    def features(self) -> np.ndarray:
        density = np.log1p(50 * self.weight / (self.words + 10))
        share = self.counts.sum(1) / (self.clauses + 1)
        return np.column_stack((np.ones(len(self.words)), np.log1p(self.counts), density, share))


def batch_events(texts: list[str | None], lexicon: Lexicon) -> Events:
    out = Events(len(texts))
    for at, group in blocks(texts):
        w = Words(group, space=_GAP)
        out.words[at : at + len(group)] = w.counts()
        if not len(w.hash):
            continue
        codes, weights = lexicon.read(w)
        # a clause ends at a stop between two words; every text ends with one
        clause = np.cumsum(_STOP[w.buf])[w.start]
        fresh = np.concatenate(([1], clause[1:] != clause[:-1])).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(fresh)))
        out.clauses[at : at + len(group)] = sums[w.first[1:]] - sums[w.first[:-1]]
        trigger = np.flatnonzero((codes == INSULT) | (codes == THREAT))
        text = np.searchsorted(w.first, trigger, "right") - 1
        some, one = np.unique(clause[trigger], return_index=True)
        lows, highs = np.searchsorted(clause, some), np.searchsorted(clause, some, "right")
        for t, lo, hi in zip(text[one].tolist(), lows.tolist(), highs.tolist(), strict=True):
            event, weight = clause_path(codes[lo:hi].tolist(), weights[lo:hi].tolist())
            out.counts[at + t, event] += 1
            out.weight[at + t] += weight
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior_sd: float = 2.0) -> np.ndarray:
    """MAP coefficients; the prior where nothing is labelled."""
    w, ridge = PRIOR_WEIGHTS.copy(), np.eye(len(PRIOR_WEIGHTS)) / prior_sd**2
    if not len(y):
        return w
    for _ in range(100):
        p = sigmoid(x @ w)
        grad = x.T @ (y - p) - ridge @ (w - PRIOR_WEIGHTS)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _text_keys(texts):
    """(text, key) of the different words and stems of each text."""
    for at, group in blocks(texts):
        w = Words(group, space=_GAP)
        text = np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1 + at
        for words, keys in ((np.arange(len(w.hash)), whole_keys(w.hash)), *stem_keys(w)):
            order = np.lexsort((keys, text[words]))
            t, key = text[words][order], keys[order]
            fresh = np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]))[: len(t)]
            yield t[fresh], key[fresh]


def _counter(candidates=None):
    """Rows (half, y, text) -> (half, key, n): texts of a half that hold a key; of the candidates if there are any."""

    def count(batches):
        for batch in batches:
            half = batch.column(0).to_numpy()
            for text, key in _text_keys(batch.column(2).to_pylist()):
                if candidates is not None:
                    at = np.minimum(np.searchsorted(candidates.value, key), len(candidates.value) - 1)
                    ok = candidates.value[at] == key
                    text, key = text[ok], key[ok]
                for h in (0, 1):
                    u, n = np.unique(key[half[text] == h], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), h, np.int32)), pa.array(u.view(np.int64)), pa.array(n)], ["half", "key", "n"])

    return count


def _odds(p: np.ndarray, n: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Lower end of the log odds ratio of holding a key, toxic texts against others."""
    a, b, c, d = p + 0.5, positives - p + 0.5, n + 0.5, negatives - n + 0.5
    return np.log(a / b) - np.log(c / d) - 2 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, Events]:
        """Scores and events of some texts."""
        events = batch_events(texts, self.lexicon)
        return sigmoid(events.features() @ self.weights), events


def _no_arcs() -> Lexicon:
    return Lexicon(np.zeros(0, np.uint64), np.zeros(0))


def _gatherer(lexicons):
    """Labelled rows -> (half, y, features), a half's read with the arcs of the other."""

    def gather(batches):
        for batch in batches:
            half, y, texts = (c.to_pylist() for c in batch.columns)
            for h in (0, 1):
                some = [i for i, x in enumerate(half) if x == h]
                x = batch_events([texts[i] for i in some], lexicons.value[1 - h]).features()
                yield pa.RecordBatch.from_arrays([pa.array([y[i] for i in some], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    return gather


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Arcs and coefficients from at most ``rows`` labelled ids of the training fold, the first by hash.

    An id's label is its largest; an id of several rows gives its smallest text.  Counts of
    keys are grouped by key; the driver gets the candidate arcs, of which a text of the bounded
    sample cannot give more than it has words and stems over ``ARC_SHARE``, and a row of features
    for each labelled id.
    """
    spark, sc = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    truth = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and id is not null")
    truth = truth.where(~held_out("id", 3, 1)).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample's ids are a table of bounded size
    sample = texts.join(F.broadcast(truth), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = sc.keep(sample.select(half, F.col("y").cast("int").alias("y"), "text"))
    size = {(r.half, r.y): r.n for r in sample.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = (np.array([size.get((h, y), 0) for h in (0, 1)]) for y in (1, 0))
    if not positives.sum() or not negatives.sum():
        sc.clear()
        return Model(_no_arcs(), PRIOR_WEIGHTS)

    def counted(y, candidates=None):
        got = sample.where(F.col("y") == y).mapInArrow(_counter(candidates), "half int, key long, n long").groupBy("key")
        return got.agg(*(F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)))

    least = max(ARC_TEXTS, int(ARC_SHARE * positives.sum()))
    toxic = counted(1).where(F.col("n0") + F.col("n1") >= least).toArrow()
    key = toxic["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, p = key[order], np.stack([toxic[f"n{h}"].to_numpy()[order] for h in (0, 1)])
    n = np.zeros_like(p)
    if len(key):
        other = counted(0, spark.sparkContext.broadcast(key)).toArrow()
        at = np.searchsorted(key, other["key"].to_numpy().view(np.uint64))
        for h in (0, 1):
            n[h, at] = other[f"n{h}"].to_numpy()

    def lexicon(halves):
        halves = list(halves)
        low = _odds(p[halves].sum(0), n[halves].sum(0), positives[halves].sum(), negatives[halves].sum())
        ok = (low > LEAST_ODDS) & (p[halves].sum(0) >= ARC_TEXTS)
        return Lexicon(key[ok], low[ok])

    lexicons = spark.sparkContext.broadcast([lexicon([0]), lexicon([1])])
    seen = sample.mapInArrow(_gatherer(lexicons), "y int, x array<double>").toArrow()
    x = seen["x"].combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
    # rows in one order, whatever task they come from, so that sums are the same
    order = np.lexsort((*x.T, seen["y"].to_numpy()))
    model = Model(lexicon([0, 1]), fit(x[order], seen["y"].to_numpy()[order].astype(float)))
    sc.clear()
    return model


def _scorer(model, column: int):
    def score(batches):
        for batch in batches:
            got, e = model.value.read(batch.column(column).to_pylist())
            found = pa.array(list(e.counts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), found, pa.array(e.clauses)], ["id", "score", "events", "clauses"])

    return score


def _keeper(model, column: int, threshold: float):
    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.value.read(batch.column(column).to_pylist())[0] < threshold))

    return keep


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted, events, clauses) for each row of ``docs``.

    ``events`` has the number of clauses of each of ``EVENTS``.  Training rows are those whose
    crc32 of the id modulo 3 is not 1 and whose label ``toxic`` is 0 or 1.  Null, empty and
    pattern-free texts get the base rate; ties and repeated rows are scored alike; without
    labels of both kinds the prior holds.  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    found = texts.mapInArrow(_scorer(model, 1), "id long, score double, events array<int>, clauses long")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return found.select("id", held_out("id", 3, 1).alias("held_out"), "score", predicted, "events", "clauses")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; see ``toxicity_scores``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    # positions, as the columns of docs may have any names
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(_keeper(model, docs.columns.index(text_col), threshold), plain.schema).toDF(*docs.columns)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from ``labels.toxic`` of the training fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity_scores(docs, labels).withColumnRenamed("id", "doc_id")
