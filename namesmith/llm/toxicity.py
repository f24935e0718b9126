"""Toxicity by weak supervision.

1. Voters. Lexicon voters fire on words of a fixed English list; induced voters
   on words and word beginnings that mark toxic training documents; pattern
   voters on shouting, on repeated signs, and on the absence of any marked word.
2. Label model. A generative model of the votes, fitted by expectation
   maximisation on labelled and unlabelled documents alike: how often each voter
   fires on toxic and on clean documents, and for each voter at most one other on
   which it depends, with the rates for both states of that one. Which depend on
   each other is estimated too: the strongest tree of dependences that the class
   doesn't explain. A known label is one more voter, which abstains elsewhere and
   whose accuracy for either class is estimated with the others: many votes can
   overrule it.
3. Classifier. A logistic regression on damped voter counts is fitted to the
   posterior labels of all these documents, as far as they are settled, and
   scores every document.

Learning takes at most ``Training.documents`` labelled and as many other
documents, chosen by a hash of their ids, one of those with equal text; scoring
reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesmith.llm import kernels
from namesmith.llm.langid import fold
from namesmith.plans.storage import cut, small_batches

#: English words of personal insult and contempt.
LEXICON = """
airhead bastard bigot bonehead bozo brainless buffoon clown coward creep cretin crook degenerate despicable dimwit
dirtbag disgusting dolt dumb dumbass dunce fatso filth fool freak garbage halfwit hateful idiot idiotic ignoramus
imbecile jackass jerk lame leech liar loser lowlife lunatic maggot moron moronic nitwit numbskull parasite pathetic
pervert pig psycho punk repulsive revolting retard rubbish scum scumbag shameful sicko simpleton slob snake sleazy
stupid sucker swine thug trash twit useless vermin vile weasel weirdo wimp worthless wretch
""".split()  # noqa: SIM905
#: Bytes of a word's beginning that may be a voter.
STEMS = (3, 4, 5, 6, 7, 8)
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


@dataclass(frozen=True)
class Training:
    """Bounds and thresholds of learning."""

    documents: int = 8_000
    voters: int = 400
    #: An induced voter fires on this share of toxic documents at least, on five at least, and so much more often than on clean ones.
    support: float = 0.01
    least: int = 5
    lift: float = 20.0
    rounds: int = 30
    #: Dependences weaker than this (nats) are left out.
    dependence: float = 0.002
    ridge: float = 0.3
    #: The accuracy of labels that the label model starts from, and the most it may find.
    trust: tuple[float, float] = (0.9, 0.999)
    #: How much a document without a label counts for the classifier.
    unlabelled: float = 0.02


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters in UTF-8."""
    out = kernels.lower_ascii(buf)
    wide = np.zeros(len(buf), bool)
    wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    return out + (wide.astype(np.uint8) << 5)


def word_marks(buf: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, np.ndarray, np.ndarray]:
    """(word index, hash) of all words and word beginnings; words; each word's document; its hash."""
    kernels.release()
    low = folded(buf)
    starts, ends, at = kernels.words(low, offs, LETTERS)
    sums = kernels.prefix(kernels.BYTES[0][low], 0)
    whole = kernels.stretch(sums, starts, ends, 0)
    marks = [(np.arange(len(starts)), whole)]
    for n in STEMS:
        which = np.flatnonzero(ends - starts > n)
        marks.append((which, kernels.stretch(sums, starts[which], starts[which] + n, 0)))
    return marks, len(starts), np.repeat(np.arange(len(offs) - 1), np.diff(at)), whole


def hashes_of(words: list[str]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return kernels.word_hashes(buf, np.r_[0, ends[:-1]], ends, 0)


def patterns(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents x 2: share of capitals, and of doubled ! or ?."""
    upper = np.r_[0, np.cumsum((buf >= 65) & (buf <= 90))]
    loud = np.zeros(len(buf), bool)
    loud[1:] = ((buf[1:] == 33) | (buf[1:] == 63)) & ((buf[:-1] == 33) | (buf[:-1] == 63))
    loud = np.r_[0, np.cumsum(loud)]
    size = np.maximum(np.diff(offs), 1)
    return np.stack([np.diff(upper[offs]) / size, np.diff(loud[offs]) / size], axis=1)


def counts(buf: np.ndarray, offs: np.ndarray, voters: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse voter counts (document, voter, times) and each document's number of marked words.

    voters are sorted hashes; table marks their low 16 bits.
    """
    marks, n, doc, _ = word_marks(buf, offs)
    hit = np.zeros(n, bool)
    pairs = []
    for which, hashes in marks:
        maybe = np.flatnonzero(table[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(voters, hashes[maybe]), len(voters) - 1)
        real = voters[at] == hashes[maybe]
        which = which[maybe[real]]
        hit[which] = True
        pairs.append(doc[which] * np.int64(len(voters)) + at[real])
    found, times = np.unique(np.concatenate(pairs), return_counts=True)
    return found // len(voters), found % len(voters), times, np.bincount(doc[hit], minlength=len(offs) - 1)


def tabled(voters: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[(voters & np.uint64(0xFFFF)).astype(np.int64)] = True
    return table


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, text, toxic: about ``bound`` labelled and as many other documents (toxic null) by hash of id, one of those with equal text.

    Both choices are bounded, so ids go to the texts and texts aren't shuffled.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    part = lambda share, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)
    chosen = cut(known.where(part(1.1 * bound / max(1, known.count()), "labelled")).orderBy(F.xxhash64("doc_id")).limit(bound), "chosen")
    own = small_batches(docs).select(F.col("doc_id").cast("long"), "text").where("text is not null")
    others = own.where(part(bound / max(1, own.count()), "others")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    rows = own.join(F.broadcast(chosen), "doc_id").unionByName(others.withColumn("toxic", F.lit(None).cast("int")))
    first = rows.groupBy(F.xxhash64("text")).agg(F.min(F.struct(F.col("toxic").isNull().alias("none"), "doc_id", "toxic", "text")).alias("r"))
    return first.select("r.doc_id", "r.text", "r.toxic")


def induce(rows: DataFrame, how: Training) -> np.ndarray:
    """Hashes of words and word beginnings that mark toxic documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                marks, _, doc, _ = word_marks(buf, offs)
                own, hashes = np.concatenate([doc[w] for w, _ in marks]), np.concatenate([h for _, h in marks])
                order = np.lexsort((own, hashes))
                own, hashes = own[order], hashes[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])] if len(own) else np.zeros(0, bool)
                own, hashes = own[new], hashes[new]
                found, at = np.unique(hashes, return_index=True)
                if len(found):
                    bad = np.add.reduceat((toxic[first + own] == 1).astype(np.int64), at)
                    yield pa.RecordBatch.from_arrays([kernels.signed(found), pa.array(bad), pa.array(np.diff(np.r_[at, len(own)]) - bad)], names=["mark", "bad", "good"])

    rows = rows.where("toxic is not null")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return np.zeros(0, np.uint64)
    total = rows.mapInArrow(emit, "mark long, bad long, good long").groupBy("mark").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = (F.col("bad") + 0.5) / (bad + 1.0) / ((F.col("good") + 0.5) / (good + 1.0))
    strong = total.where((F.col("bad") >= max(how.least, how.support * bad)) & (lift >= how.lift))
    top = strong.orderBy(F.desc("bad"), "good", "mark").limit(how.voters).collect()
    return np.array([r["mark"] for r in top], np.int64).view(np.uint64)


def dependences(votes: np.ndarray, post: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent (-1 for none): the forest of greatest mutual information given the class."""
    k, n = votes.shape[1], len(votes)
    info = np.zeros((k, k))
    for w in (post, 1 - post):
        both = (votes * w[:, None]).T @ votes + 0.25
        one, total = np.diag(both).copy(), w.sum() + 1
        for a in (0, 1):
            for b in (0, 1):
                cell = both if a and b else one[:, None] - both if a else one[None, :] - both if b else total - one[:, None] - one[None, :] + both
                pa, pb = (one if a else total - one)[:, None], (one if b else total - one)[None, :]
                cell = np.maximum(cell, 1e-6)
                info += cell / n * np.log(cell * total / (pa * pb))
    info[np.tril_indices(k)] = 0
    tree, near = list(range(k)), [[] for _ in range(k)]

    def top(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    for flat in np.argsort(-info, axis=None)[: np.count_nonzero(info > least)].tolist():
        i, j = divmod(flat, k)
        if top(i) != top(j):
            tree[top(i)] = top(j)
            near[i].append(j)
            near[j].append(i)
    parent, seen = np.full(k, -1), np.zeros(k, bool)
    for root in range(k):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            i = todo.pop()
            for j in near[i]:
                if not seen[j]:
                    seen[j], parent[j] = True, i
                    todo.append(j)
    return parent


def label_model(votes: np.ndarray, signs: np.ndarray, labels: np.ndarray, how: Training) -> tuple[np.ndarray, tuple[float, float]]:
    """Posterior that each document is toxic, from binary votes and labels (NaN: none), and the labels' accuracy on toxic and on clean ones.

    signs: 1 for voters that speak for toxic, -1 for those against, 0 for those
    that may do either. Such a voter's rates keep that order; it is all that
    tells the two classes apart.
    """
    speak = (votes * (signs > 0)).sum(axis=1)
    post = np.clip(0.25 * speak + 0.01, 0.01, 0.99)
    parent = np.full(votes.shape[1], -1)
    known, named, trust = ~np.isnan(labels), labels == 1, [how.trust[0]] * 2
    for step in range(2 * how.rounds):
        if step == how.rounds:
            parent = dependences(votes, post, how.dependence)
        given = votes[:, parent] * (parent >= 0)
        joint = votes * given
        logs = []
        rates = []
        for w in (post, 1 - post):
            fires, with_parent, together, total = w @ votes, w @ given, w @ joint, w.sum()
            rates.append([(fires - together + 0.5) / (total - with_parent + 1), (together + 0.5) / (with_parent + 1)])
        (bad0, bad1), (good0, good1) = rates
        for bad, good in ((bad0, good0), (bad1, good1)):
            wrong = (signs != 0) & ((bad - good) * signs < 0)
            bad[wrong] = good[wrong] = (bad[wrong] + good[wrong]) / 2
        for r0, r1 in ((bad0, bad1), (good0, good1)):
            r0, r1 = np.clip(r0, 1e-5, 1 - 1e-5), np.clip(r1, 1e-5, 1 - 1e-5)
            y0, n0, y1, n1 = np.log(r0), np.log(1 - r0), np.log(r1), np.log(1 - r1)
            logs.append(joint @ (y1 - y0 - n1 + n0) + votes @ (y0 - n0) + given @ (n1 - n0) + n0.sum())
        share = np.clip(post.mean(), 1e-4, 0.5)
        told = np.where(named, np.log(trust[0] / (1 - trust[1])), np.log((1 - trust[0]) / trust[1])) * known
        new = 1 / (1 + np.exp(-np.clip(logs[0] - logs[1] + told + np.log(share / (1 - share)), -30, 30)))
        for i, (w, right) in enumerate(((new, named), (1 - new, known & ~named))):
            trust[i] = float(np.clip((w @ right + 9) / (w @ known + 10), 0.5, how.trust[1]))
        done, post = np.abs(new - post).max() < 1e-4, new
        if done and step >= how.rounds:
            break
    return tempered(logs[0] - logs[1] + np.log(share / (1 - share)), labels, how)


def tempered(z: np.ndarray, labels: np.ndarray, how: Training) -> tuple[np.ndarray, tuple[float, float]]:
    """The posterior where votes that still depend on each other count as much as they bear out.

    Votes' logits are scaled by two numbers, fitted on documents with labels
    together with the labels' accuracies: a label is the class that the scaled
    votes make likely, seen through its errors. Labels then join as a voter.
    """
    known, named, trust = ~np.isnan(labels), labels == 1, [how.trust[0]] * 2
    z, able = np.clip(z, -30, 30), known.any() and named.any() and (known & ~named).any()
    slope, shift = 1.0, 0.0
    for _ in range(how.rounds):
        told = np.where(named, np.log(trust[0] / (1 - trust[1])), np.log((1 - trust[0]) / trust[1])) * known
        post = 1 / (1 + np.exp(-np.clip(slope * z + shift + told, -30, 30)))
        for i, (w, right) in enumerate(((post, named), (1 - post, known & ~named))):
            trust[i] = float(np.clip((w @ right + 9) / (w @ known + 10), 0.5, how.trust[1]))
        if able:
            slope, shift = logistic(z[known][:, None], post[known], np.ones(int(known.sum())), 1.0)
            slope = max(slope, 0.05)
    return post, (trust[0], trust[1])


def logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps; ``count`` says how much each row counts."""
    x = np.c_[x, np.ones(len(x))].astype(np.float32)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = ((x * (count * p * (1 - p) + 1e-6).astype(np.float32)[:, None]).T @ x).astype(float)
        step = np.linalg.solve(curve + np.diag(penalty), x.T @ (count * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    voters: np.ndarray
    weights: np.ndarray


def features(buf: np.ndarray, offs: np.ndarray, voters: np.ndarray, table: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Sparse damped counts, and dense columns: marked words (damped), two or more of them, patterns."""
    doc, voter, times, hits = counts(buf, offs, voters, table)
    return (doc, voter, np.log1p(times)), np.c_[np.log1p(hits), hits >= 2, patterns(buf, offs)]


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Learn voters, posterior labels and weights. Without a toxic training document the score is constant."""
    rows = cut(training_rows(docs, labels, how.documents), "training")
    induced = induce(rows, how)
    voters = np.unique(np.concatenate([hashes_of(LEXICON), induced]))
    table = tabled(voters)
    schema = "doc_id long, toxic int, voters array<long>, times array<double>, dense array<double>"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                (doc, voter, times), dense = features(buf, offs, voters, table)
                at, n = np.searchsorted(doc, np.arange(len(offs))).astype(np.int32), len(offs) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n), batch.column("toxic").slice(first, n), pa.ListArray.from_arrays(pa.array(at), pa.array(voter)), pa.ListArray.from_arrays(pa.array(at), pa.array(times)),
                        pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * dense.shape[1]).astype(np.int32)), pa.array(dense.reshape(-1).astype(float))),
                    ],
                    names=["doc_id", "toxic", "voters", "times", "dense"],
                )

    got = rows.mapInArrow(emit, schema).toPandas().sort_values("doc_id")
    if not len(got) or got["toxic"].nunique() < 2:
        return Model(voters, np.r_[np.zeros(len(voters) + 4), -4.0])
    x = np.zeros((len(got), len(voters)), np.float32)
    for i, (v, t) in enumerate(zip(got["voters"], got["times"], strict=True)):
        x[i, v] = t
    dense = np.stack(got["dense"].to_list()).astype(np.float32)
    votes = np.c_[x > 0, dense[:, :1] == 0, dense[:, 2] > 0.3, dense[:, 3] > 0].astype(np.float32)
    signs = np.r_[np.ones(len(voters)), -1, 0, 0]
    used = votes.any(axis=0)
    labels = got["toxic"].to_numpy(dtype=float)
    post, _ = label_model(votes[:, used].astype(float), signs[used], labels, how)
    # What the label model leaves open teaches little.
    sure = (2 * post - 1) ** 2 * np.where(np.isnan(labels), how.unlabelled, 1.0)
    return Model(voters, logistic(np.c_[x, dense], post, sure, how.ridge))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, then score and predicted; null and empty texts get the score of no votes.

    A column of docs named score or predicted is left out.
    """
    voters, weights = model.voters, model.weights
    table = tabled(voters)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, buf, offs in kernels.slices(*kernels.utf8(batch.column("text"))):
                (doc, voter, times), dense = features(buf, offs, voters, table)
                z = dense @ weights[len(voters) : -1] + weights[-1] + np.bincount(doc, times * weights[voter], minlength=len(offs) - 1)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    docs = small_batches(docs).drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(emit, schema)


def score_held_out(docs: DataFrame, labels: DataFrame, buckets: int = 3, held: int = 1, how: Training = Training()) -> DataFrame:
    """Learn on labels outside the held-out fold, then score every document. Rows repeat as they come."""
    model = fit(docs, labels.where(fold("doc_id", buckets) != held), how)
    return score(docs.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", (F.coalesce(fold("doc_id", buckets), F.lit(-1)) == held).alias("held_out"), "score", "predicted")
