"""Cross-entropy difference between matched target and background bigram models.

**Matched**: the target is the documents that the caller aims at, the background is drawn from
the others, and of both as much is taken, by a hash of the row, as the smaller one has in
characters. **Own words left out**: texts are dealt by a hash into two folds, equal texts
together, each with a target and a background model of its own; a text is scored by the models
of the other fold, so it makes no difference whether it was in a sample. All four models know
the words of both samples and one unknown word, have a start mark, and use the same
interpolated Kneser-Ney smoothing.

With ``weight`` the share of a context that backs off and ``lower`` the probability of a word
by the number of words it follows, the loss of a bigram is

    -log(own(h, w) + weight(h) * lower(w)) = context(h) + follower(w) + bonus(h, w)

where context = -log weight, follower = -log lower, and the bonus is 0 unless the model saw the
bigram. So a text's bigrams go to the place of their first word only, which knows that word as
context and, since every word but the start mark is followed by another or by an end mark, as
follower too. Tasks send bigrams as compressed arrays, one row per gathered ``MEMORY`` words and
bucket; a bucket counts its part of the models from the sampled texts among them. What it needs
besides, the numbers of words that its words follow, comes from a first round of counting.

A word is known by 48 bits of a hash of its spelling (of 50 million words some four pairs share one). The most frequent words (``HOT``, or four a
bucket) and pairs of them are looked up where the text is read, from a list whose length is
bounded by the number of buckets; other bigrams of such a word are dealt by both words. So no
word or pair, however frequent, gathers in one task. The hot list is found in a sample of
``HOT_SAMPLE`` characters; which words are in it changes the place of work, never a result.

A document's score is the mean over its tokens of target loss minus background loss, in nats:
the lower, the more it reads like the target. Losses are summed as whole multiples of 1 / SCALE
nats, so that the order of the sum changes nothing.

Defined results: a null or empty text has no tokens, losses of 0 and score 0; very long texts
are read whole; repeated rows count as often as they occur and get equal scores; a null in
``aimed`` counts as not aimed at; where either sample is empty all models are uniform; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored
from shelfwise.operators.skew import join_counted

START, END = 0, 1
#: Words a task gathers before it sends their bigrams.
MEMORY = 1_200_000
#: Characters of text whose bigrams share a bucket, and the least number of buckets.
BUCKET, BUCKETS = 16_000_000, 12
#: Least length of the hot list, and the characters of text it is found in.
HOT, HOT_SAMPLE = 1024, 1 << 24
SCALE = 2**20
FOLDS = 2
#: Models: target and background of fold 0, target and background of fold 1.
MODELS = 2 * FOLDS
#: Rows of a bucket: words it needs, local sums that only pass through, bigrams.
NEED, SUMS, BIGRAMS = 0, 1, 2
PLACES = 1 << 30


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _code(word: str) -> int:
    found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "little")
    return found if found not in (START, END) else found + 2


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _place(*salt: str) -> Column:
    """A place in [0, 1) by a hash of the row."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), *map(F.lit, salt)), F.lit(PLACES)) / float(PLACES)


def matched(documents: DataFrame, aimed: Column) -> tuple[DataFrame, int]:
    """key, text, fold and role (1 target, 2 background, 0 neither) of each row that has a text, and the characters of all."""
    rows = documents.select(
        _text_key().alias("key"), F.col("text").cast("string").alias("text"), F.coalesce(aimed, F.lit(False)).alias("aimed"),
        _place("matched").alias("place"), _place("hot").alias("hot_place")).where(F.length("text") > 0)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int"))
    size = {(r["fold"], r["aimed"]): r["n"] for r in rows.groupBy("fold", "aimed").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()}
    share = F.lit(0.0)
    for (fold, side), n in sorted(size.items()):
        share = F.when((F.col("fold") == fold) & (F.col("aimed") == side), min(1.0, size.get((fold, not side), 0) / n)).otherwise(share)
    role = F.when(F.col("place") >= share, 0).when(F.col("aimed"), 1).otherwise(2)
    return rows.select("key", "text", "fold", role.alias("role"), "hot_place"), sum(size.values())


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit code for a pair of codes."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _find(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of codes in a sorted list, its length where they are not in it."""
    at = np.searchsorted(codes, wanted)
    return np.where(codes[np.minimum(at, len(codes) - 1)] == wanted, at, len(codes)) if len(codes) else np.zeros(len(wanted), np.int64)


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes of equal weight together, compressed."""
    return zstandard.compress(pickle.dumps(
        {k: (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()) for k, a in arrays.items()}), 3)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    found = {}
    for name, (kind, raw) in pickle.loads(zstandard.decompress(data)).items():
        wide = np.dtype(kind).itemsize
        found[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel()
    return found


def _listed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between the distinct values in order, and the place of each value among them."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.diff(distinct, prepend=0), at.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)


class Vocabulary(dict):
    """Numbers of the words met so far, after those of the start and the end mark."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 2
        return number

    def codes(self) -> np.ndarray:
        return np.fromiter((START, END, *map(_code, self)), np.int64, len(self) + 2)


class Hot:
    """Values of the most frequent words and pairs; one column a model and a last row of zeros for all others."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.pairs = np.zeros(0, np.int64)
        self.context = self.follower = np.zeros((len(codes) + 1, MODELS), np.int64)
        self.bonus = np.zeros((1, MODELS), np.int64)


class Gathered:
    """Bigrams of the texts of some batches, per text or, for counting, per model."""

    def __init__(self, hot: Hot, buckets: int, per_text: bool):
        self.hot, self.buckets, self.per_text = hot, buckets, per_text
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.found, self.size = Vocabulary(), [], 0
        self.texts: dict[int, list[int]] = {}  # key: number, fold, times target, times background, copies, words

    def add(self, key: int, text: str, fold: int, role: int) -> None:
        old = self.texts.get(key)
        if self.per_text and old:
            old[2], old[3], old[4] = old[2] + (role == 1), old[3] + (role == 2), old[4] + 1
            return
        known = [self.vocabulary[w] for w in words(text)]
        if not known:
            return
        if self.per_text:
            number = len(self.texts)
            self.texts[key] = [number, fold, int(role == 1), int(role == 2), 1, len(known)]
        else:
            number = 2 * fold + role - 1
        self.found.append((number, np.array((START, *known, END), np.int32)))
        self.size += len(known) + 1

    def rows(self):
        """bucket, kind and data of everything gathered."""
        if not self.found:
            return
        code = self.vocabulary.codes()
        text = np.repeat(np.array([k for k, _ in self.found], np.int32), [len(x) - 1 for _, x in self.found])
        pair = np.concatenate([x[:-1].astype(np.int64) << 32 | x[1:] for _, x in self.found])
        if not self.per_text:  # one model after the other
            order = np.lexsort((text, pair))
        else:
            order = np.argsort(pair, kind="stable")
        pair, text = pair[order], text[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))
        n = np.diff(np.append(first, len(pair))).astype(np.int32)
        h, w, text = (pair[first] >> 32).astype(np.int32), (pair[first] & 0xFFFFFFFF).astype(np.int32), text[first]
        del pair, order, first
        hot = _find(self.hot.codes, code)
        is_hot = hot < len(self.hot.codes)
        if self.per_text:
            about = np.array(list(self.texts.values()), np.int64)
            keys = np.fromiter(self.texts, np.int64, len(self.texts))
            model = 2 * (1 - about[text, 1])
            bonus = np.full(len(h), len(self.hot.pairs))
            both = np.flatnonzero(is_hot[h] & is_hot[w])
            bonus[both] = _find(self.hot.pairs, _mix(code[h[both]], code[w[both]]))
            sums = [np.bincount(text, n * (self.hot.context[hot[h], model + side] * (w != END) + self.hot.follower[hot[w], model + side]
                                           + self.hot.bonus[bonus, model + side]), len(keys)).astype(np.int64) for side in (0, 1)]
            yield int(keys[0] % self.buckets), SUMS, _packed(
                key=keys, copies=about[:, 4].astype(np.uint32), n=about[:, 5].astype(np.uint32), target=sums[0], background=sums[1])
            sent = np.flatnonzero((bonus == len(self.hot.pairs)) & ~(is_hot[h] & (w == END)))
        else:
            about = np.array([[k, k // 2, k % 2 == 0, k % 2 == 1, 1, 0] for k in range(MODELS)], np.int64)
            keys = np.zeros(MODELS, np.int64)
            sent = np.flatnonzero(w != END)
        h, w, text, n = h[sent], w[sent], text[sent], n[sent]
        place = np.mod(np.where(is_hot[h], _mix(code[h], code[w]), code[h]), self.buckets)
        order = np.argsort(place, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            if not len(part):
                continue
            texts, at = np.unique(text[part], return_inverse=True)
            h_steps, h_at = _listed(code[h[part]])
            w_steps, w_at = _listed(code[w[part]])
            yield int(place[part[0]]), BIGRAMS, _packed(
                h_steps=h_steps, h_at=h_at, w_steps=w_steps, w_at=w_at, text=at.astype(h_at.dtype if len(texts) <= 1 << 16 else np.uint32),
                n=n[part].astype(np.uint32), key=keys[texts], fold=about[texts, 1].astype(np.uint8),
                as_target=about[texts, 2].astype(np.uint32), as_background=about[texts, 3].astype(np.uint32))


def bigrams(rows: DataFrame, hot: Hot, buckets: int, per_text: bool) -> DataFrame:
    """bucket, kind, data: the bigrams of the texts."""
    def gather(batches):
        held = Gathered(hot, buckets, per_text)

        def sent():
            found = list(held.rows())
            held.clear()
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                                 ["bucket", "kind", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "fold", "role")), strict=True):
                held.add(*row)
                if held.size > MEMORY:
                    yield from sent()
        yield from sent()

    return rows.select("key", "text", "fold", "role").mapInArrow(gather, "bucket int, kind int, data binary")


def _by_bucket(batches):
    """Each bucket's rows, as slices of batches that are sorted by bucket."""
    current, parts = None, []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for low, high in zip(cuts, cuts[1:]):
            if high == low:
                continue
            if parts and bucket[low] != current:
                yield current, parts
                parts = []
            current = int(bucket[low])
            parts.append(batch.slice(low, high - low))
    if parts:
        yield current, parts


class Bucket:
    """The bigrams of one bucket and what they say of the models."""

    def __init__(self, sent: list[dict[str, np.ndarray]]):
        whole = lambda name: np.concatenate([s[name] for s in sent])
        h = np.concatenate([np.cumsum(s["h_steps"])[s["h_at"]] for s in sent])
        w = np.concatenate([np.cumsum(s["w_steps"])[s["w_at"]] for s in sent])
        offsets = np.cumsum([0, *(len(s["key"]) for s in sent)])
        self.text = np.concatenate([(s["text"] + o).astype(np.int32) for s, o in zip(sent, offsets)])
        self.n, self.key, self.fold = whole("n").astype(np.int32), whole("key"), whole("fold").astype(np.int64)
        ended, mixed = w == END, _mix(h, w)
        order = np.argsort(mixed)
        new = np.append(True, np.diff(mixed[order]) != 0)
        first = order[new]
        self.h, self.w = h[first], w[first]
        del h, w, mixed
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        n = np.where(ended, 0, self.n)
        times = [whole("as_target").astype(np.int64), whole("as_background").astype(np.int64)]
        self.counts = np.stack([np.bincount(self.pair, n * (times[m % 2] * (self.fold == m // 2))[self.text], len(first)).astype(np.int32)
                                for m in range(MODELS)], axis=1)
        self.contexts, self.context = np.unique(self.h, return_inverse=True)
        self.totals = _summed(self.context, self.counts, len(self.contexts))
        self.kinds = _summed(self.context, self.counts > 0, len(self.contexts))


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, m], size).astype(np.int64) for m in range(MODELS)], axis=1)


#: What counting tells of a bucket: a word and how many words it follows; a hot context's totals and kinds; a hot
#: pair's counts; how many bigrams occur once and twice.
FOLLOWERS, CONTEXT, PAIR, SEEN = range(4)
_COUNTED = "kind int, bucket int, code long, other long, " + ", ".join(f"a{k} long" for k in range(2 * MODELS))


def counted(rows: DataFrame, hot: Hot, buckets: int, often: float) -> DataFrame:
    """The first round: kind, bucket, code, other and counts; pairs of hot words from ``often`` occurrences on."""
    def count(batches):
        for bucket, parts in _by_bucket(batches):
            got = Bucket([_unpacked(d) for p in parts for d in p.column("data").to_pylist()])
            followers, at = np.unique(got.w, return_inverse=True)
            empty = np.zeros((len(followers), MODELS), np.int64)
            is_hot = _find(hot.codes, got.contexts) < len(hot.codes)
            pairs = np.flatnonzero((got.counts.sum(axis=1) >= often) & is_hot[got.context] & (_find(hot.codes, got.w) < len(hot.codes)))
            for kind, code, other, values in (
                (FOLLOWERS, followers, followers, np.hstack([_summed(at, got.counts > 0, len(followers)), empty])),
                (CONTEXT, got.contexts[is_hot], got.contexts[is_hot], np.hstack([got.totals, got.kinds])[is_hot]),
                (PAIR, got.h[pairs], got.w[pairs], np.hstack([got.counts, np.zeros_like(got.counts)])[pairs]),
                (SEEN, np.zeros(1, np.int64), np.zeros(1, np.int64), np.hstack([(got.counts == k).sum(axis=0) for k in (1, 2)])[None]),
            ):
                fixed = [np.full(len(code), kind, np.int32), np.full(len(code), bucket, np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*fixed, code, other, *np.ascontiguousarray(values.T.astype(np.int64)))],
                    [c.split()[0] for c in _COUNTED.split(", ")])

    sent = bigrams(rows.where("role > 0"), hot, buckets, per_text=False)
    return sent.repartition(4 * buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _COUNTED)


class Smoothing:
    """What the models need beside a bucket's own counts: a few totals."""

    def __init__(self, seen: list[int], size: int, pairs: list[int], followers: list[int]):
        self.discount = np.array([_discount(seen[m], seen[MODELS + m]) for m in range(MODELS)])
        self.pairs, self.size = np.array(pairs, np.float64), size
        self.floor = np.where(self.pairs > 0, self.discount * followers / np.maximum(self.pairs, 1) / size, 1 / size)

    def lower(self, followed: np.ndarray, m=slice(None)) -> np.ndarray:
        """Probability of words by the numbers of words they follow, of one model or one column a model."""
        return np.maximum(followed - self.discount[m], 0) / np.maximum(self.pairs[m], 1) + self.floor[m]

    def weight(self, totals: np.ndarray, kinds: np.ndarray, m=slice(None)) -> np.ndarray:
        return np.where(totals > 0, self.discount[m] * kinds / np.maximum(totals, 1), 1.0)

    def bonus(self, counts: np.ndarray, totals: np.ndarray, kinds: np.ndarray, followed: np.ndarray, m=slice(None)) -> np.ndarray:
        own = np.where(counts > 0, counts - self.discount[m], 0) / np.maximum(totals, 1)
        return whole(-np.log(own / (self.weight(totals, kinds, m) * self.lower(followed, m)) + 1))


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def whole(loss: np.ndarray) -> np.ndarray:
    return np.rint(loss * SCALE).astype(np.int64)


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


#: Places where the sums of texts are added up.
ADDERS = 256
_SUMS = ("key", "copies", "rows", "n", "target", "background")


def _bundled(need: DataFrame) -> DataFrame:
    """bucket, kind, data: the words that buckets need, with the numbers of words they follow, as arrays."""
    def bundle(batches):
        held, size = [], 0

        def sent():
            bucket, code, *numbers = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("bucket", "code", *(f"a{m}" for m in range(MODELS))))
            order = np.lexsort((code, bucket))
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((int(bucket[part[0]]), NEED, _packed(steps=np.diff(code[part], prepend=0), **{f"a{m}": x[part] for m, x in enumerate(numbers)})))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > MEMORY:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return need.select("bucket", "code", *(f"a{m}" for m in range(MODELS))).mapInArrow(bundle, "bucket int, kind int, data binary")


def scored(rows: DataFrame, need: DataFrame, hot: Hot, buckets: int, smoothing: Smoothing) -> DataFrame:
    """key and sums of copies, rows, words and losses, one row a key.

    A text has a partial sum in every bucket that one of its bigrams is in, so at most one a bigram. They go as
    arrays, one row a bucket and place of the keys, and are added up there.
    """
    def score(batches):
        for _, parts in _by_bucket(batches):
            table = pa.Table.from_batches(parts)
            kind = table.column("kind").to_numpy()
            data = table.column("data")
            sent, need = [], []
            for k in range(len(kind)):
                found = _unpacked(data[k].as_py())
                if kind[k] == SUMS:
                    yield _dealt(found["key"], found["copies"], np.ones(len(found["key"])), found["n"], found["target"], found["background"])
                else:
                    (sent if kind[k] == BIGRAMS else need).append(found)
            if sent:
                empty = {"steps": np.zeros(0, np.int64), **{f"a{m}": np.zeros(0, np.int64) for m in range(MODELS)}}
                need.append(empty)
                known, first = np.unique(np.concatenate([np.cumsum(x["steps"]) for x in need]), return_index=True)
                followed = np.stack([np.concatenate([x[f"a{m}"] for x in need])[first] for m in range(MODELS)], axis=1).astype(np.int64)
                yield _score(Bucket(sent), known, np.vstack([followed, np.zeros((1, MODELS), np.int64)]))

    def _score(got: Bucket, known: np.ndarray, followed: np.ndarray):
        place = _find(hot.codes, got.contexts)
        is_hot = place < len(hot.codes)
        word, as_word = _find(known, got.w), _find(known, got.contexts)
        going_on = got.w != END
        sums = [np.zeros(len(got.key), np.int64) for _ in range(2)]
        for m in range(MODELS):  # one after the other, to hold one column at a time
            totals, kinds = (np.where(is_hot, h[place, m], g[:, m]) for h, g in ((hot.totals, got.totals), (hot.kinds, got.kinds)))
            loss = smoothing.bonus(got.counts[:, m], totals[got.context], kinds[got.context], followed[word, m], m)
            # A hot word's own losses were added where the text was read.
            loss += np.where(is_hot, 0, whole(-np.log(smoothing.lower(followed[as_word, m], m))))[got.context]
            loss += np.where(is_hot, 0, whole(-np.log(smoothing.weight(totals, kinds, m))))[got.context] * going_on
            other = np.flatnonzero((got.fold == 1 - m // 2)[got.text])
            sums[m % 2] += np.bincount(got.text[other], got.n[other].astype(np.int64) * loss[got.pair[other]], len(got.key)).astype(np.int64)
        zero = np.zeros(len(got.key))
        distinct, at = np.unique(got.key, return_inverse=True)  # a key comes once for each time its text was sent
        sums = [_added(at, x, len(distinct)) for x in sums]
        zero = np.zeros(len(distinct))
        return _dealt(distinct, zero, zero, zero, *sums)

    def _dealt(*columns):
        place = np.mod(columns[0], ADDERS)
        order = np.lexsort((columns[0], place))
        parts = np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []
        packed = [_packed(**{c: x[part].astype(np.int64) for c, x in zip(_SUMS, columns, strict=True)}) for part in parts]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(place[part[0]]) for part in parts], pa.int32()), pa.array(packed, pa.binary())], ["place", "data"])

    def add(batches):
        held, size = [], 0

        def together():
            key = np.concatenate([h["key"] for h in held])
            distinct, at = np.unique(key, return_inverse=True)
            return {"key": distinct, **{c: _added(at, np.concatenate([h[c] for h in held]), len(distinct)) for c in _SUMS[1:]}}

        for batch in batches:
            for data in batch.column("data"):
                held.append(_unpacked(data.as_py()))
                size += len(held[-1]["key"])
                if size > MEMORY:
                    held = [together()]
                    size = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in together().values()], list(_SUMS))

    sent = bigrams(rows, hot, buckets, per_text=True)
    dealt = sent.unionByName(_bundled(need)).repartition(4 * buckets, "bucket").sortWithinPartitions("bucket", "kind")
    partial = dealt.mapInArrow(score, "place int, data binary")
    return partial.repartition(ADDERS, "place").mapInArrow(add, ", ".join(f"{c} long" for c in _SUMS))


def hot_words(rows: DataFrame, share: float, length: int) -> np.ndarray:
    """Codes of the start mark and of the most frequent words of a share of the rows, in order."""
    def count(batches):
        found: Counter[str] = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([_code(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["code", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(words(text))
                if len(found) > MEMORY:
                    yield sent()
                    found.clear()
        if found:
            yield sent()

    read = rows.where(F.col("hot_place") < share).select("text").mapInArrow(count, "code long, n long")
    top = read.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(length).collect()
    return np.unique(np.array([START, *(r["code"] for r in top)], np.int64))


def cross_entropy_difference(documents: DataFrame, aimed: Column, least_hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every whole text; the target is where ``aimed`` holds."""
    rows, size = matched(documents, aimed)
    buckets = max(BUCKETS, math.ceil(size / bucket))
    length = max(least_hot, 4 * buckets if least_hot else 0)
    hot = Hot(hot_words(rows, HOT_SAMPLE / max(size, 1), length))
    # A pair that makes up more than 1 / length of the characters counts as hot: 16 * length pairs at most.
    stats = stored(counted(rows, hot, buckets, max(1.0, size / 16 / max(length, 1))), "lm-counts")
    numbers = [f"a{k}" for k in range(2 * MODELS)]
    seen = stats.where(F.col("kind") == SEEN).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers)).first()
    followers = stored(stats.where(F.col("kind") == FOLLOWERS).groupBy("code").agg(*(F.sum(c).alias(c) for c in numbers[:MODELS])), "lm-words")
    sizes = followers.agg(F.count(F.lit(1)).alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers[:MODELS]),
                          *(F.count_if(F.col(c) > 0).alias(f"with_{c}") for c in numbers[:MODELS])).first()
    smoothing = Smoothing([seen[c] for c in numbers], sizes["words"] + 1, [sizes[c] for c in numbers[:MODELS]],
                          [sizes[f"with_{c}"] for c in numbers[:MODELS]])
    frequent = stats.where(F.col("kind").isin(CONTEXT, PAIR)).groupBy("kind", "code", "other").agg(*(F.sum(c).alias(c) for c in numbers))
    _fill(hot, frequent, followers, smoothing)
    need = stats.where(F.col("kind") == FOLLOWERS).select("bucket", "code").join(followers, "code").unionByName(
        followers.withColumn("bucket", F.pmod("code", F.lit(buckets)).cast("int")))
    sums = stored(scored(rows, need, hot, buckets, smoothing), "lm-sums")
    mean = lambda c: (F.col(c) / F.col("n") / SCALE).alias(f"{c}_loss")
    per_text = sums.select("key", "copies", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"), mean("target"), mean("background"))
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"))
    joined = join_counted(named, per_text, "key", "copies", how="left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return joined.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), zero("target_loss"), zero("background_loss")).withColumn(
        "score", F.col("target_loss") - F.col("background_loss"))


def _fill(hot: Hot, counts: DataFrame, followers: DataFrame, smoothing: Smoothing) -> None:
    """Give the hot words and pairs their values; as many rows reach the driver as the list is long, and pairs as bounded there."""
    spark = counts.sparkSession
    size = len(hot.codes)
    hot.totals, hot.kinds, followed = (np.zeros((size + 1, MODELS), np.int64) for _ in range(3))
    pairs = []
    for row in counts.collect():
        values = np.array([row[f"a{k}"] for k in range(2 * MODELS)], np.int64)
        if row["kind"] == CONTEXT:
            at = int(np.searchsorted(hot.codes, row["code"]))
            hot.totals[at], hot.kinds[at] = values[:MODELS], values[MODELS:]
        else:
            pairs.append((row["code"], row["other"], values[:MODELS]))
    listed = spark.createDataFrame(pa.table({"code": hot.codes}))
    for row in followers.join(F.broadcast(listed), "code", "left_semi").collect():
        followed[int(np.searchsorted(hot.codes, row["code"]))] = [row[f"a{m}"] for m in range(MODELS)]
    hot.context = whole(-np.log(smoothing.weight(hot.totals, hot.kinds)))
    hot.follower = whole(-np.log(smoothing.lower(followed)))
    hot.context[size] = hot.follower[size] = 0
    hot.follower[np.searchsorted(hot.codes, START)] = 0
    if pairs:
        h, w = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        codes = _mix(h, w)
        order = np.argsort(codes)
        at = np.searchsorted(hot.codes, h)
        bonus = smoothing.bonus(np.stack([p[2] for p in pairs]), hot.totals[at], hot.kinds[at], followed[np.searchsorted(hot.codes, w)])
        hot.pairs, hot.bonus = codes[order], np.vstack([bonus[order], np.zeros((1, MODELS), np.int64)])
