"""Toxicity by weak supervision: a generative model of many voters labels the documents, a linear classifier learns from its posterior.

*Voters.* Lexicons of insulting words in four languages, grouped by kind, and patterns of address, each vote by firing or not on a document. Further lexicons are mined: words that
a likelihood-ratio test finds to go with toxic marks, in a sample of at most ``LABELLED`` marked documents of the training fold (those of the smallest hash of the id), dealt into ``MINED_GROUPS`` voters. The marks of the
training fold are one more voter, which may be absent: it is not taken as truth, its accuracy is estimated like that of the others.

*Generative model.* A latent class per document. Given the class, the voters form a tree: each depends on the class and on at most one other voter. The tree
is the maximum spanning tree of the conditional mutual information between voters, estimated under the posterior of a model without correlations, and is learnt anew once the
correlations are in. Accuracies and correlations are estimated by expectation maximisation over the table of vote
patterns, whose size is bounded by the number of voters (2 to the power of ``len(VOTERS)``, times three) and not by the number of documents. The class on which the voters fire more often is the toxic one.

*Classifier.* Logistic regression on the posterior as soft labels, over the documents of the training fold. Its inputs are words of the text (those whose posterior-weighted document
counts tell the classes apart most), the share of such words that insult, and a constant; words that are in no lexicon count too. Each gradient is one distributed sum, added up in two steps so that no task
gets one row from every partition; only vectors of the model's size reach the driver.

Inputs of a score come from the text alone. Rows whose crc32(doc_id as text) mod 3 is 1 are held out: neither their marks nor their texts are learnt from. Defined cases: a null or empty text has no words and no
votes and is scored like any other; a null ``doc_id`` belongs to the training fold and has no mark; of several marks of one id the highest counts; repeated rows are repeated in the result. Without any vote that
fires in the training fold all documents score the share of toxic marks there (0 without marks). Empty tables give no rows. Other columns aren't read. Very long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_words import byte_rule, coded_words, text_slices
from .common import Sent, safe_join, table, written
from .pu_quality import fold

#: Words are runs of ASCII letters and non-ASCII characters.
RULE = byte_rule(bytes(b for b in range(128) if not chr(b).isalpha()))
ACCEPT = 0.7
#: Lengths of beginnings of words that count beside the words.
STARTS = (5, 6)
#: Words that the classifier uses, and the documents of the training fold in which a word has to stand.
FEATURES = 1024
LEAST_DOCUMENTS = 5
#: Marked documents that words are mined from, most words to mine, their voters, and the least test value and share of toxic documents of a word.
LABELLED = 50_000
MINED = 2000
MINED_GROUPS = 4
TEST = 20.0
SHARE = 0.6
ROUNDS = 40
STEPS = 60
RIDGE = 3e-5

# Insulting words by kind, in four languages.
LEXICONS = {
    "stupidity": "stupid idiot idiots idiotic moron morons moronic imbecile imbeciles dumb dumbass fool fools dimwit halfwit brainless cretin dunce nitwit dummkopf idioten schwachkopf blöd dumm trottel depp bête stupide débile crétin imbécile estúpido estúpida idiota imbécil tonto bobo tarado",
    "worth": "worthless useless loser losers failure nobody wretch wertlos versager nichtsnutz nutzlos minable raté inútil perdedor fracasado despreciable",
    "filth": "trash garbage scum filth filthy vermin scumbag pig pigs rat dirtbag müll abschaum dreck schwein drecksau ordure racaille déchet basura escoria mugre cerdo",
    "disgust": "disgusting disgust vile revolting repulsive nasty hideous sickening ugly ekelhaft widerlich hässlich abscheulich dégoûtant répugnant immonde asqueroso repugnante feo",
    "ridicule": "clown clowns joke pathetic laughable ridiculous lame embarrassing coward freak weirdo witzfigur erbärmlich lächerlich feigling pathétique lâche bouffon patético payaso ridículo cobarde",
    "abuse": "bastard bitch asshole jerk fuck fucking shit crap damn whore slut arschloch scheiße hurensohn miststück connard salaud salope merde putain cabrón mierda puta pendejo hijueputa",
    "hatred": "hate hateful despise loathe kill burn hasse hass verrecke haine crève déteste odio odiar muérete maldito maldita",
}
PATTERNS = {
    "address": r"\b(you|your|youre|u|du|dich|dein|tu|toi|ton|eres|tu)\W{1,3}(\w+\W){0,3}(idiot|moron|loser|clown|scum|trash|stupid|pathetic|worthless|disgusting|dumm|stupide|inutile|tonto)",
    "silence": r"shut\s+up|get\s+lost|go\s+away|go\s+to\s+hell|halt\s+die|ta\s+gueule|cállate",
    "shouting": r"!{3,}|\b[a-z]+!\s+[a-z]+!",
}
#: A lexicon votes when one of its words stands in the text, the last voter when several different insults do.
VOTERS = [*LEXICONS, *(f"mined{k}" for k in range(MINED_GROUPS)), *PATTERNS, "several"]


class Lexicon:
    """All words that vote, and per word the bits of its voters."""

    def __init__(self, mined: list[str] = ()):
        bits: dict[str, int] = {}
        for k, words in enumerate(LEXICONS.values()):
            for word in words.split():
                bits[word] = bits.get(word, 0) | 1 << k
        for word in mined:
            # An insult that the marks confirm is in a voter of both sorts.
            bits[word] = bits.get(word, 0) | 1 << len(LEXICONS) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % MINED_GROUPS
        self.words, self.bits = pa.array(list(bits), pa.large_string()), np.array(list(bits.values()), np.int64)

    def kinds(self, distinct: pa.Array) -> np.ndarray:
        at = pc.index_in(distinct, value_set=self.words)
        return np.where(at.is_valid().to_numpy(zero_copy_only=False), self.bits[pc.fill_null(at, 0).to_numpy()], 0)


class Words:
    """Words of some texts: the row and the code of each, and the tokens that a distinct word stands for, which are itself and, marked by a star, its beginnings."""

    def __init__(self, texts: pa.Array):
        self.rows, self.codes, distinct = coded_words(texts, RULE)
        size = pc.utf8_length(distinct)
        starts = [pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct, 0, k), pa.scalar("*", distinct.type), pa.scalar("", distinct.type)), distinct) for k in STARTS]
        coded = pc.dictionary_encode(pa.concat_arrays([distinct, *starts]))
        self.of_word, self.tokens, self.n = coded.indices.to_numpy().reshape(len(STARTS) + 1, -1), coded.dictionary, len(texts)

    def pairs(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The different tokens of each text, as rows and token codes; only the ``wanted`` ones if given."""
        found = []
        for own in self.of_word:
            if wanted is None:
                found.append(self.rows.astype(np.int64) << 32 | own[self.codes])
            else:
                hit = wanted[own][self.codes]
                found.append(self.rows[hit].astype(np.int64) << 32 | own[self.codes[hit]])
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, pairs & 0xFFFFFFFF


def votes(texts: pa.Array, words: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Per text the bits of the voters that fire, and the share of insults among its words."""
    kinds = lexicon.kinds(words.tokens)
    rows, codes = words.pairs(kinds > 0)
    fired = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(fired, rows, kinds[codes])
    fired |= (np.bincount(rows, minlength=len(texts)) > 2).astype(np.int64) << VOTERS.index("several")
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    for name, pattern in PATTERNS.items():
        fired |= pc.match_substring_regex(lowered, pattern).to_numpy(zero_copy_only=False).astype(np.int64) << VOTERS.index(name)
    insult = kinds[words.of_word[0]] > 0
    return fired, np.bincount(words.rows, insult[words.codes], len(texts)) / (np.bincount(words.rows, minlength=len(texts)) + 20.0)


class VoteModel:
    """P(votes, class) with one parent voter per voter at most; the mark is a last voter of values 0, 1 and 2 (absent)."""

    def __init__(self, n_voters: int):
        self.n, self.parent = n_voters, [-1] * n_voters
        self.prior, self.tables, self.mark = 0.5, [np.full((2, 2, 2), 0.5) for _ in range(n_voters)], np.full((2, 2), 0.5)

    def joint(self, fired: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Log P(votes, class) for both classes; an absent mark says nothing."""
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(fired), 1))
        for v in range(self.n):
            above = fired[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(fired), np.int64)
            out += np.log(self.tables[v][:, above, fired[:, v]]).T
        known = marks < 2
        out[known] += np.log(self.mark[:, marks[known]]).T
        return out

    def posterior(self, fired: np.ndarray, marks: np.ndarray) -> np.ndarray:
        gap = np.diff(self.joint(fired, marks), axis=1)[:, 0]
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))

    def update(self, fired: np.ndarray, marks: np.ndarray, weight: np.ndarray, p: np.ndarray) -> None:
        """Accuracies and correlations from posteriors, each count raised by one half."""
        by_class = np.stack([weight * (1 - p), weight * p])
        self.prior = float((by_class[1].sum() + 0.5) / (weight.sum() + 1))
        for v in range(self.n):
            above = fired[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(fired), np.int64)
            for c in range(2):
                cells = np.bincount(above * 2 + fired[:, v], by_class[c], 4).reshape(2, 2) + 0.5
                self.tables[v][c] = cells / cells.sum(1, keepdims=True)
        for c in range(2):
            cells = np.bincount(marks, by_class[c], 3)[:2] + 0.5
            self.mark[c] = cells / cells.sum()

    def correlate(self, fired: np.ndarray, weight: np.ndarray, p: np.ndarray) -> None:
        """The tree of the strongest correlations given the class (maximum spanning tree of conditional mutual information)."""
        shared = np.zeros((self.n, self.n))
        for part in (weight * (1 - p), weight * p):
            total = part.sum() + 2
            one = (part @ fired + 1) / total
            both = ((fired * part[:, None]).T @ fired + 0.5) / total
            for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                pa_, pb_ = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
                cell = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}[a, b]
                cell = np.maximum(cell, 1e-12)
                shared += total * cell * np.log(cell / np.maximum(pa_ * pb_, 1e-12))
        inside, self.parent = {0}, [-1] * self.n
        while len(inside) < self.n:
            # A link has to be worth more than the two numbers that it adds.
            gain, v, above = max((shared[a, b], b, a) for a in inside for b in range(self.n) if b not in inside)
            self.parent[v] = above if gain > np.log(weight.sum() + 2) else -1
            inside.add(v)


def fit_votes(fired: np.ndarray, marks: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """``fired``: patterns by voter as 0 and 1; ``marks``: 0, 1 or 2 (absent); ``weight``: the documents of each pattern."""
    model = VoteModel(fired.shape[1])
    # A start that leans towards documents on which more voters fire.
    p = np.clip(fired.sum(1) / 3, 0.02, 0.98)
    for links in (False, True, True):
        if links:
            model.correlate(fired, weight, p)
        for _ in range(rounds):
            model.update(fired, marks, weight, p)
            p = model.posterior(fired, marks)
    return model


def unpack(bits: np.ndarray, n: int = len(VOTERS)) -> np.ndarray:
    return (np.asarray(bits, np.int64)[:, None] >> np.arange(n)) & 1


def _vote(lexicon):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        insults = lexicon.value
        for batch in text_slices(batches):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes(texts, Words(texts), insults)[0])], names=["doc_id", "bits"])

    return vote


def _marked_words(shared):
    """Per word the documents of the sample that hold it, and the toxic ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = shared.value
        for batch in text_slices(batches):
            own = pc.fill_null(batch.column("doc_id"), -1).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            some = np.flatnonzero((ids[at] == own) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            if not len(some):
                continue
            own = Words(batch.column("text").take(pa.array(some)))
            (rows, word), distinct = own.pairs(), own.tokens
            mark = toxic[at[some]]
            n = np.bincount(word, minlength=len(distinct))
            bad = np.bincount(word, mark[rows], len(distinct)).astype(np.int64)
            seen = np.flatnonzero(n)
            words = pa.concat_arrays([distinct.take(pa.array(seen)).cast(pa.string()), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[seen], len(some))), pa.array(np.append(bad[seen], mark.sum()))], names=["word", "n", "toxic"])

    return count


def mined_words(training: DataFrame, marks: DataFrame, labelled: int = LABELLED, most: int = MINED) -> list[str]:
    """Words that go with toxic marks by a likelihood-ratio test; ``marks`` has ``doc_id`` and ``mark``, one row per document."""
    spark = training.sparkSession
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toArrow()
    if sample.num_rows == 0:
        return []
    ids = sample.column("doc_id").to_numpy()
    order = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[order], sample.column("mark").to_numpy()[order] > 0))
    counted = training.mapInArrow(_marked_words(shared), "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = written(counted.where(F.col("word").isNull() | ((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") >= SHARE * F.col("n")))), "toxic-marked")
    total = counts.where("word IS NULL").first()
    if total is None or not total.toxic:
        return []
    rate, share = total.toxic / total.n, F.col("toxic") / F.col("n")
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    test = F.round(2 * F.col("n") * (part(share, F.lit(rate)) + part(1 - share, F.lit(1 - rate + 1e-12))), 6)
    likely = counts.where("word IS NOT NULL").withColumn("test", test).where((F.col("test") >= TEST) & (share > rate))
    return [r.word for r in likely.orderBy(F.col("test").desc(), "word").limit(most).collect()]


def _word_evidence(shared, lexicon):
    """Per word the documents that hold it and the posterior mass of toxic ones among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, insults = shared.value, lexicon.value
        for batch in text_slices(batches):
            own = Words(batch.column("text"))
            fired, (rows, word), distinct = votes(batch.column("text"), own, insults)[0], own.pairs(), own.tokens
            p = model.posterior(unpack(fired), np.full(len(fired), 2))
            n = np.bincount(word, minlength=len(distinct))
            toxic = np.bincount(word, p[rows], len(distinct))
            some = np.flatnonzero(n)
            words = pa.concat_arrays([distinct.take(pa.array(some)).cast(pa.string()), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n[some], len(fired))), pa.array(np.append(toxic[some], p.sum()))], names=["word", "n", "toxic"])

    return count


def _features(shared, lexicon):
    """Words of the model that stand in a text (their numbers), its insult share, and its votes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, insults = shared.value, lexicon.value
        for batch in text_slices(batches):
            own = Words(batch.column("text"))
            fired, share = votes(batch.column("text"), own, insults)
            at = pc.fill_null(pc.index_in(own.tokens, value_set=known), -1).to_numpy()
            rows, codes = own.pairs(at >= 0)
            sizes = np.bincount(rows, minlength=len(fired))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(at[codes].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fired), lists, pa.array(share)], names=["doc_id", "bits", "words", "share"])

    return extract


def _design(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and numbers of the words that stand, and the dense inputs (insult share on a log scale, constant)."""
    lists = batch.column("words")
    sizes = np.diff(lists.offsets.to_numpy())
    share = batch.column("share").to_numpy()
    return np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(), np.column_stack([np.log1p(200 * share), np.ones(len(share))])


def _margin(weights: np.ndarray, rows: np.ndarray, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
    return np.bincount(rows, weights[:-2][words], len(dense)) + dense @ weights[-2:]


def _summed(parts: DataFrame) -> np.ndarray:
    """Sum of the rows' vectors: in as many groups as the root of their number, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column("sums"):
                own = row.values.to_numpy()
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    groups = max(1, int(parts.sparkSession.sparkContext.defaultParallelism ** 0.5))
    rows = parts.coalesce(groups).mapInArrow(add, "sums array<double>").toArrow().column("sums").combine_chunks()
    return np.sum([r.values.to_numpy() for r in rows], axis=0) if len(rows) else np.zeros(0)


def _gradients(spark: SparkSession, weights: np.ndarray):
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros(2 + len(w))
        for batch in batches:
            rows, words, dense = _design(batch, len(w))
            z, y = _margin(w, rows, words, dense), batch.column("p").to_numpy()
            miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            total[:2] += len(y), (np.logaddexp(0, z) - y * z).sum()
            total[2:-2] += np.bincount(words, miss[rows], len(w) - 2)
            total[-2:] += miss @ dense
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    return run


def fit_linear(rows: DataFrame, n_words: int, steps: int = STEPS) -> np.ndarray:
    """Weights of the words, of the insult share and of the constant; limited-memory quasi-Newton steps with a falling step length."""
    spark = rows.sparkSession

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = _summed(rows.mapInArrow(_gradients(spark, w), "sums array<double>"))
        n = max(total[0], 1.0)
        return total[1] / n + RIDGE * (w[:-1] @ w[:-1]) / 2, total[2:] / n + RIDGE * np.append(w[:-1], 0)

    w = np.zeros(n_words + 2)
    loss, gradient = value(w)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = -gradient, []
        for s, y in reversed(history):
            a = (s @ step) / (s @ y)
            kept.append(a)
            step = step - a * y
        if history:
            s, y = history[-1]
            step = step * (s @ y) / (y @ y)
        for (s, y), a in zip(history, reversed(kept)):
            step = step + s * (a - (y @ step) / (s @ y))
        length = 1.0 if history else 1.0 / max(np.abs(gradient).sum(), 1e-9)
        for _ in range(8):
            new_loss, new_gradient = value(w + length * step)
            if new_loss <= loss + 1e-4 * length * (gradient @ step):
                break
            length /= 4
        else:
            break
        s, y = length * step, new_gradient - gradient
        if s @ y > 1e-12:
            history = [*history[-7:], (s, y)]
        done = loss - new_loss < 1e-6
        w, loss, gradient = w + s, new_loss, new_gradient
        if done:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's id, fold, score and verdict; ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    training = plain.where(~held)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("mark"))
    marks = marks.where(fold(F.col("doc_id"), 3) != 1)
    marks = written(marks, "toxic-marks")
    lexicon = Sent(spark, Lexicon(mined_words(training, marks)))
    voted = written(safe_join(training.mapInArrow(_vote(lexicon), "doc_id long, bits long"), marks, ["doc_id"]).select("bits", F.coalesce("mark", F.lit(2)).alias("mark")), "toxic-votes")
    patterns = voted.groupBy("bits", "mark").agg(F.count("*").alias("n")).toArrow()
    bits, mark, n = (patterns.column(c).to_numpy() for c in ("bits", "mark", "n"))
    if not (bits > 0).any():
        share = n[mark == 1].sum() / max(n[mark < 2].sum(), 1)
        out = plain.select("doc_id", held.alias("held_out"), F.lit(float(share)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
    model = Sent(spark, fit_votes(unpack(bits), mark.astype(np.int64), n.astype(float)))
    known = pa.array(telling_words(training, model, lexicon), pa.large_string())
    words = spark.sparkContext.broadcast(known)
    features = plain.mapInArrow(_features(words, lexicon), "doc_id long, bits long, words array<int>, share double").withColumn("held_out", held)
    features = written(safe_join(features, marks, ["doc_id"]), "toxic-features")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            p = fitted.posterior(unpack(batch.column("bits").to_numpy()), pc.fill_null(batch.column("mark"), 2).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("words"), batch.column("share"), pa.array(p)], names=["words", "share", "p"])

    soft = written(features.where(~F.col("held_out")).select("bits", "mark", "words", "share").mapInArrow(label, "words array<int>, share double, p double"), "toxic-soft")
    weights = fit_linear(soft, len(known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = 1 / (1 + np.exp(-np.clip(_margin(weights, *_design(batch, len(weights))), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values)], names=["doc_id", "held_out", "score"])

    out = features.select("doc_id", "held_out", "words", "share").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def telling_words(training: DataFrame, model, lexicon, most: int = FEATURES) -> list[str]:
    """The words whose document counts differ most between the classes, by the posterior of the voters; ties by the word."""
    counts = written(training.mapInArrow(_word_evidence(model, lexicon), "word string, n long, toxic double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("word").isNull() | (F.col("n") >= LEAST_DOCUMENTS)), "toxic-words")
    total = counts.where("word IS NULL").first()
    if total is None or not total.n:
        return []
    rate = total.toxic / total.n
    # How far the toxic mass of a word lies from what the overall rate would give it, in standard deviations; rounded, so that sums in another order agree.
    far = F.round(F.abs(F.col("toxic") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate) + 1), 6)
    return [r.word for r in counts.where("word IS NOT NULL").withColumn("far", far).orderBy(F.col("far").desc(), "word").limit(most).collect()]


def op13_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
