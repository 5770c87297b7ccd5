"""Near-duplicate records by a parity-sketch join (problem 1).

The tokens of a text are the distinct q-character substrings of the text without
white space, lower-cased. Every token flips one bit of a bit sketch, so bits set by
shared tokens are the same in both sketches and the Hamming distance of two sketches
is at most the size of the sets' symmetric difference. A Jaccard similarity of at
least s bounds that difference by (1-s)/(1+s) of the summed sizes; split into blocks,
two such sketches agree in many whole blocks. Blocks are joined by equality, within a
band of set sizes; what is joined must pass the bound on the sizes and on the Hamming
distance of a short parity sketch of sampled tokens (``sieve``) before a pair is counted,
and every candidate is verified on the whole texts.

Blocks with fewer than b tokens say nothing and make no key; a size band's sketches have
b to 2b tokens a block on average. Candidates agree in at least two blocks. The number of
blocks is chosen so that a pair at exactly the threshold agrees in 12 of them on average
at the worst place of a band (``plan_blocks``): it is missed with a probability of
13 * exp(-12) = 8e-5, pairs above the threshold with far less. The sieve's limit lies 4.5
standard deviations above what a pair at the threshold has (3e-6). Chance agreements fall
steeply with b, so b grows with the logarithm of the number of rows; what is found does
not depend on it. The hash functions are fixed, so results don't vary between runs.

A key that more than ``HOT`` different texts hold makes no pairs. Its texts, all of them,
are sketched anew with a token more a block, which leaves less than a tenth of the chance
agreements: two texts that share a hot key share all keys of the next level too, so no
link is lost. On the last level the hot keys left are joined in a grid of slices.

Texts with equal token sets share one fingerprint and are joined once, as one class;
a group of copies never makes pairs before the final expansion.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.session import cut_lineage

_U = np.uint64
#: Blocks in which candidates agree at least.
AGREE = 2
#: Different texts that hold a key, beyond which the key is hot.
HOT = 1000
#: Levels of ever more tokens a block that texts with hot keys go through.
LEVELS = 3
#: Rows up to which blocks have three tokens; a token more for every twelvefold.
ROWS = 1_200_000
#: Copies of one text that are paired with all of its copies in one task.
COPIES_A_SLICE = 2000


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def squeeze(text: str) -> str:
    """The text without white space, lower-cased."""
    return "".join(text.split()).lower()


def token_hashes(text: str, q: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the q-character substrings; empty if shorter."""
    s = squeeze(text)
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _U(0x9E3779B97F4A7C15) + a[i : i + n] + _U(0x632BE59BD9B4E019)
    return np.unique(_mix(h))


def fingerprint(h: np.ndarray) -> int:
    """One signed 64-bit value for a whole token set; 0 for the empty one."""
    if not len(h):
        return 0
    whole = np.bitwise_xor.reduce(_mix(h + _U(1)), keepdims=True) + _U(len(h))
    return int(_mix(whole).view(np.int64)[0])


def plan_blocks(similarity: float, per_block: int, expected: float = 12.0) -> int:
    """Blocks in which a pair at the threshold agrees ``expected`` times on average, at its worst size."""

    def agree(t: float) -> float:
        differ, shared = 2 * (1 - similarity) / (1 + similarity) * t, 2 * similarity / (1 + similarity) * t
        few = sum(math.exp(-shared) * shared**k / math.factorial(k) for k in range(per_block))
        return math.exp(-differ) * (1 - few)

    return math.ceil(expected / min(agree(per_block * (1 + x / 8)) for x in range(9)))


def _block_keys(h: np.ndarray, band: int, blocks: int, per_block: int, bits: int = 256) -> np.ndarray:
    """Keys of the informative blocks of the sketch used in ``band`` (sizes 2**band to 2**(band+1))."""
    m = max(1, (1 << band) // per_block)
    out = []
    for rnd in range(-(-blocks // m)):
        g = h if rnd == 0 else _mix(h + _U((rnd * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        block = ((g >> _U(32)) % _U(m)).astype(np.int64)
        left = blocks - rnd * m
        if m > left:
            keep = block < left
            block, g = block[keep], g[keep]
        if not len(block):
            continue
        # the bit of the token in its block's sketch; the block is kept as the XOR of the set bits' codes
        code = _mix((g & _U(bits - 1)) + _U((((band << 24) | (rnd << 16)) + 1) * 0x9FB21C651E98DF25 & (2**64 - 1)))
        order = np.argsort(block, kind="stable")
        b, c = block[order], code[order]
        start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[start, len(b)])
        word = np.bitwise_xor.reduceat(c, start)
        full = size >= per_block
        where = b[start[full]].astype(np.uint64) + _U((band << 40) | (rnd << 32))
        out.append(_mix(word[full] ^ _mix(where + _U(0x2545F4914F6CDD1D))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch_keys(h: np.ndarray, similarity: float, per_block: int = 3, blocks: int | None = None) -> list[tuple[int, np.ndarray]]:
    """(band, join keys) of a token set: of its own size band and, if a partner may be in it, of the next."""
    n = len(h)
    if not n:
        return []
    blocks = blocks or plan_blocks(similarity, per_block)
    band = n.bit_length() - 1
    keys = [(band, _block_keys(h, band, blocks, per_block))]
    if n / similarity >= 1 << (band + 1):
        keys.append((band + 1, _block_keys(h, band + 1, blocks, per_block)))
    if n < 64:  # too few tokens for independent blocks: pairs of a token and a salt are keys, two a token, which misses no pair
        keys.append((0, np.concatenate([_mix(h ^ _U(x)) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)])))
    return keys


#: Bits of a sieve, and what the rest of its third word holds: the band, and the set's size on a scale of OCTAVE steps a doubling.
SIEVE_BITS, OCTAVE = 171, 2048
_WORD = _U((1 << 64) - 1)


def _rate(band):
    """Share of tokens that a band's sieve samples: 128 to 256 of a set, or all of a smaller one."""
    return np.minimum(1.0, 128.0 / 2.0 ** np.asarray(band))


def sieve(h: np.ndarray, band: int) -> tuple[int, int, int]:
    """A parity sketch of sampled tokens in three words, with the band and the size."""
    g = _mix(h ^ _U(0xA24BAED4963EE407))
    rate = float(_rate(band))
    if rate < 1:
        g = g[g < _U(int(rate * 2.0**64))]
    bit = (_mix(g) >> _U(16)) % _U(SIEVE_BITS)
    odd = np.flatnonzero(np.bincount(bit.astype(np.int64), minlength=SIEVE_BITS) & 1)
    whole = sum(1 << int(x) for x in odd)
    third = (whole >> 128) << 21 | band << 16 | min(65535, round(OCTAVE * math.log2(len(h))))
    return whole & (2**64 - 1), (whole >> 64) & (2**64 - 1), third


@functools.lru_cache(maxsize=64)
def _limits(similarity: float, band: int) -> np.ndarray:
    """Hamming distance that a sieve of a pair with this sum of sizes, in 512 steps a band, has at most: mean and 4.5 standard deviations."""
    at = np.arange(512 * 4 + 1) / 512.0 * 2.0**band  # sums of sizes from 0 to four times the band's least
    p = float(_rate(band))
    differ = (1 - similarity) / (1 + similarity) * at
    m, b = differ * p, SIEVE_BITS
    q, q2 = (1 - 2 / b) ** m, (1 - 4 / b) ** m
    odd = (1 - q) / 2
    noise = b * odd * (1 - odd) + b * (b - 1) * ((1 - 2 * q + q2) / 4 - odd**2)
    spread = q**2 * m * (1 - p)
    loose = b * odd + 4.5 * np.sqrt(np.maximum(noise + spread, 0)) + 1
    sure = m + 4.5 * np.sqrt(m * (1 - p))  # the distance is never more than the sampled difference
    return np.ceil(np.minimum(loose, sure)).astype(np.int64)


def sifted(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sieves (n x 3 words each, of one band) may have the similarity."""
    code_a, code_b = (a[:, 2] & _U(0xFFFF)).astype(np.int64), (b[:, 2] & _U(0xFFFF)).astype(np.int64)
    band = ((a[:, 2] >> _U(16)) & _U(31)).astype(np.int64)
    fit = np.abs(code_a - code_b) <= OCTAVE * math.log2(1 / similarity) + 2
    differ = np.bitwise_count(a[:, 0] ^ b[:, 0]) + np.bitwise_count(a[:, 1] ^ b[:, 1]) + np.bitwise_count((a[:, 2] >> _U(21)) ^ (b[:, 2] >> _U(21)))
    total = np.exp2(code_a / OCTAVE) + np.exp2(code_b / OCTAVE)
    for x in np.unique(band):
        if x == 0:  # keys of small sets: the sieve has all tokens
            here = band == 0
            fit[here] &= differ[here] <= np.ceil((1 - similarity) / (1 + similarity) * total[here] + 0.5)
        else:
            here = np.flatnonzero((band == x) & fit)
            at = np.minimum(np.ceil(total[here] / 2.0 ** int(x) * 512).astype(np.int64), 2048)
            fit[here] = differ[here] <= _limits(similarity, int(x))[at]
    return fit


_KEYS = "key long, fp long, w0 long, w1 long, w2 long"


def _fingerprint_batches(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [token_hashes(text, q) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32())], names=["id", "fp", "n"]
            )

    return run


def _key_batches(q: int, similarity: float, per_block: int):
    blocks = plan_blocks(similarity, per_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's copies of one text make its keys once
        for batch in batches:
            keys, fps, words = [], [], []
            for text in batch.column(0).to_pylist():
                h = token_hashes(text, q)
                fp = fingerprint(h)
                if fp in seen:
                    continue
                seen.add(fp)
                for band, k in sketch_keys(h, similarity, per_block, blocks):
                    keys.append(k)
                    fps.append(np.full(len(k), fp, np.int64))
                    words.append(np.broadcast_to(np.array(sieve(h, band), np.uint64), (len(k), 3)))
            if keys:
                w = np.concatenate(words).view(np.int64)
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(fps), w[:, 0], w[:, 1], w[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "fp", "w0", "w1", "w2"])

    return run


def _meet_batches(similarity: float, hot: int):
    """Of rows sorted by (key, fp): pairs of different texts that share a key and pass the sieve; of hot keys every row, its text once with fp_b null."""

    def pairs(key: np.ndarray, fp: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        at, step = np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            for lo in range(0, len(at), 1 << 18):
                i = at[lo : lo + (1 << 18)]
                i = i[sifted(words[i], words[i + step], similarity)]
                left.append(fp[i])
                right.append(fp[i + step])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def emit(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], names=["fp_a", "fp_b", "hot_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.uint64)]
        burning: int | None = None  # the hot key that the batch before ended in
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            key = np.concatenate([held[0], cols[0]])
            fp = np.concatenate([held[1], cols[1]])
            words = np.concatenate([held[2], np.stack(cols[2:], axis=1).view(np.uint64)])
            fresh = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]  # copies in several tasks
            key, fp, words = key[fresh], fp[fresh], words[fresh]
            if burning is not None:
                mine = key == burning
                if mine.any():
                    yield emit(fp[mine], None, key[mine])
                    key, fp, words = key[~mine], fp[~mine], words[~mine]
            if not len(key):
                held = [key, fp, words]
                continue
            burning = None
            # the last key may go on in the next batch
            last = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - last > hot:
                burning, last = int(key[-1]), len(key)
            held = [key[last:], fp[last:], words[last:]]
            key, fp, words = key[:last], fp[:last], words[:last]
            yield from settle(key, fp, words)
        yield from settle(*held)

    def settle(key: np.ndarray, fp: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        often = np.repeat(size, size)
        warm = often > hot
        if warm.any():
            yield emit(fp[warm], None, key[warm])
        some = (often > 1) & ~warm
        a, b = pairs(key[some], fp[some], words[some])
        if len(a):
            yield emit(np.minimum(a, b), np.maximum(a, b), None)

    return run


def _grid_batches(similarity: float):
    """Of pairs of rows that share a hot key: those that pass the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)]
            fit = sifted(np.stack(cols[2:5], axis=1).view(np.uint64), np.stack(cols[5:8], axis=1).view(np.uint64), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][fit]), pa.array(cols[1][fit])], names=["fp_a", "fp_b"])

    return run


def _verify_batches(q: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def tokens(key: int, text: str) -> np.ndarray:
            if key not in kept:
                if len(kept) > 4000:
                    kept.clear()
                kept[key] = token_hashes(text, q)
            return kept[key]

        for batch in batches:
            a, b, sims = [], [], []
            for fa, fb, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = tokens(fa, ta), tokens(fb, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if union and both / union >= similarity:
                    a.append(fa)
                    b.append(fb)
                    sims.append(both / union)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["fp_a", "fp_b", "similarity"]
            )

    return run


def _candidates(texts: DataFrame, members: DataFrame, similarity: float, q: int, per_block: int) -> DataFrame:
    """(fp_a, fp_b): pairs of different token sets that agree in at least AGREE blocks and pass the sieve."""
    found, part = None, texts.select("text")
    for level in range(LEVELS):
        keys = part.mapInArrow(_key_batches(q, similarity, per_block + level), _KEYS)
        sorted_ = keys.repartition("key").sortWithinPartitions("key", "fp")
        met = cut_lineage(sorted_.mapInArrow(_meet_batches(similarity, HOT), "fp_a long, fp_b long, hot_key long"))
        pairs = met.where("fp_b is not null").select("fp_a", "fp_b")
        agreed = pairs.groupBy("fp_a", "fp_b").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE).select("fp_a", "fp_b")
        found = agreed if found is None else found.unionByName(agreed)
        hot = met.where("hot_key is not null")
        if hot.isEmpty():
            return found.distinct() if level else found
        if level + 1 < LEVELS:
            # one text of each class that holds a hot key goes on
            chosen = members.join(hot.select(F.col("fp_a").alias("fp")).distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
            part = cut_lineage(texts.join(chosen.select("id"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))).select("text")
    # keys still hot: a row meets the whole key in one slice, a slice holds HOT of its rows
    slices = hot.groupBy(F.col("hot_key").alias("key")).agg(F.ceil(F.count("*") / F.lit(HOT)).cast("int").alias("s"))
    rows = cut_lineage(keys.distinct().join(slices, "key"))
    a = rows.select("key", F.pmod(F.xxhash64("fp"), F.col("s").cast("long")).cast("int").alias("slice"), F.col("fp").alias("fp_a"), *[F.col(f"w{k}").alias(f"a{k}") for k in range(3)])
    b = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("slice"), F.col("fp").alias("fp_b"), *[F.col(f"w{k}").alias(f"b{k}") for k in range(3)])
    grid = a.join(b, ["key", "slice"]).where("fp_a < fp_b").select("fp_a", "fp_b", "a0", "a1", "a2", "b0", "b1", "b2")
    passed = grid.mapInArrow(_grid_batches(similarity), "fp_a long, fp_b long")
    # with the last level's other keys they agree often enough; a pair of hot keys alone does so here
    both = pairs.unionByName(passed).groupBy("fp_a", "fp_b").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE).select("fp_a", "fp_b")
    return found.unionByName(both).distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, similarity: float, q: int, min_chars: int, per_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: id, fp; links: fp_a, fp_b, similarity), one fp for each distinct token set."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= min_chars)
    )
    if per_block is None:
        # chance agreements of unlike texts grow with the square of the rows; a token more a block leaves a tenth of them.
        # The table's own count (of its file footers, no text is read) bounds the texts' number from above
        per_block = 3 + max(0, math.ceil(math.log(max(1, df.count()) / ROWS, 12)))
    members = texts.mapInArrow(_fingerprint_batches(q), "id long, fp long, n int")
    members = cut_lineage(members.where("n > 0").select("id", "fp").distinct())
    candidates = cut_lineage(_candidates(texts, members, similarity, q, per_block))
    wanted = candidates.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct()
    chosen = members.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    shown = chosen.join(texts, "id").groupBy("fp").agg(F.max("text").alias("text"))
    shown = cut_lineage(shown)
    pairs = (
        candidates.join(shown.select(F.col("fp").alias("fp_a"), F.col("text").alias("text_a")), "fp_a")
        .join(shown.select(F.col("fp").alias("fp_b"), F.col("text").alias("text_b")), "fp_b")
        .select("fp_a", "fp_b", "text_a", "text_b")
    )
    links = pairs.mapInArrow(_verify_batches(q, similarity), "fp_a long, fp_b long, similarity double")
    return members, cut_lineage(links)


def near_duplicate_pairs(
    df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, q: int = 5, min_chars: int = 200
) -> DataFrame:
    """All pairs (id_a < id_b) of rows whose token sets have at least this Jaccard similarity.

    Null ids and texts, and texts shorter than ``min_chars`` or ``q``, are in no pair. A row
    repeated with its id counts once. Identical texts are pairs. Other columns are ignored.
    """
    members, links = _classes(df, id_col, text_col, similarity, q, min_chars)
    # a class of many copies is cut into slices, so that no task holds all of its pairs
    slices = members.groupBy("fp").agg(F.ceil(F.count("*") / F.lit(COPIES_A_SLICE)).cast("int").alias("s"))
    members = members.join(slices, "fp")
    a = members.select(F.col("id").alias("x"), F.col("fp").alias("fp_a"), F.pmod(F.xxhash64("id"), F.col("s").cast("long")).cast("int").alias("slice"))
    b = members.select(F.col("id").alias("y"), F.col("fp").alias("fp_b"))
    every = members.select(F.col("id").alias("y"), F.col("fp").alias("fp_a"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("slice"))
    between = links.select("fp_a", "fp_b").join(a, "fp_a").join(b, "fp_b")
    within = a.join(every, ["fp_a", "slice"]).where("x < y")
    return (
        between.select("x", "y")
        .unionByName(within.select("x", "y"))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .where("id_a < id_b")
    )


def near_duplicate_groups(
    df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, q: int = 5, min_chars: int = 200, max_rounds: int = 40
) -> DataFrame:
    """One row an id: id, group_id (least id of its connected group), n_links, n_copies.

    ``n_links`` counts the linked classes of different texts, ``n_copies`` the rows with the
    same token set. Labels are spread by minimum along links with pointer jumping, in a few
    rounds of joins; every round is cut, nothing is collected. Texts too short to be compared
    are a class with the equal ones, null texts are classes of their own; neither has links.
    """
    members, links = _classes(df, id_col, text_col, similarity, q, min_chars)
    classes = members.groupBy("fp").agg(F.min("id").alias("label"), F.count("*").alias("n_copies"))
    edges = cut_lineage(links.select("fp_a", "fp_b").unionByName(links.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b"))))
    labels = cut_lineage(classes.select("fp", "label").join(edges.select(F.col("fp_a").alias("fp")).distinct(), "fp", "left_semi"))
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("fp").alias("fp_b"), "label"), "fp_b").groupBy(F.col("fp_a").alias("fp")).agg(F.min("label").alias("least"))
        step = labels.join(near, "fp", "left").select("fp", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        # jump: the label's own label, where the labelled class has found a lesser one
        jump = step.groupBy("label").agg(F.min("next").alias("jump"))
        step = step.join(jump, "label").select("fp", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved"))
        step = cut_lineage(step)
        labels = step.select("fp", "label")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    degree = edges.groupBy(F.col("fp_a").alias("fp")).agg(F.count("*").alias("n_links"))
    per = (
        classes.withColumnRenamed("label", "own")
        .join(labels, "fp", "left")
        .join(degree, "fp", "left")
        .select("fp", F.coalesce("label", "own").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    )
    compared = members.join(per, "fp").select("id", "group_id", "n_links", "n_copies")
    # the rest: equal short texts by their hash
    rest = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).isNull().alias("none")).where("id is not null")
    rest = cut_lineage(rest.join(members.select("id"), "id", "left_anti").groupBy("id").agg(F.max(F.struct("h", "none")).alias("x")).select("id", "x.h", "x.none"))
    equal = rest.where("not none").groupBy("h").agg(F.min("id").alias("group_id"), F.count("*").alias("n_copies"))
    zero, one = F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    return (
        compared.unionByName(rest.where("not none").join(equal, "h").select("id", "group_id", zero, "n_copies"))
        .unionByName(rest.where("none").select("id", F.col("id").alias("group_id"), zero, one))
    )
