"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a word-unigram base.

The trie of byte contexts up to ORDER bytes long is a table: counts of (context, byte) of every training document. Documents fall
into blocks of about BLOCK bytes by hash of doc_id. A block sends the distinct keys it has, with its counts, to buckets by hash of
the key; buckets add up counts over blocks and send back to each block what it needs to score its own texts. So no task ever holds
the model, and what travels is distinct keys, packed as sorted arrays. Blocks grow in number with the corpus; buckets follow the
distinct keys, of which there are far fewer, and are streamed: a task holds one bucket's distinct keys and no more of its blocks
than a batch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, splitmix, stored, text_chunks, word_hashes, word_spans

#: Longest context in bytes; a context and its byte fill a 64-bit key for up to 7.
ORDER = 5
BLOCK = 8 << 20
#: Text to a bucket, and the most buckets: a bucket's share of some 10**10 distinct keys is then still a few million.
SHARE, BUCKETS = 16 << 20, 4096
#: Two bytes that UTF-8 never has: what comes before a text, and its end.
START, END = 0xFE, 0xFF
GRAM, WORD = 0, 1


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def tally(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each are counted. Plain sorts are several times faster than sorts by index."""
    yes, no = np.sort(keys[counted]), np.unique(keys[~counted])
    at = np.flatnonzero(np.r_[True, yes[1:] != yes[:-1]]) if len(yes) else np.zeros(0, np.int64)
    return add_up(np.concatenate([yes[at], no]), np.concatenate([np.diff(np.r_[at, len(yes)]), np.zeros(len(no), np.int64)]))


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte, and end, of concatenated texts: its context and itself; and the number of keys before each text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.full(len(data) + n * (order + 1), START, np.uint8)
    out[np.arange(len(data)) + text * (order + 1) + order] = data
    out[offsets[1:] + np.arange(n) * (order + 1) + order] = END
    key = np.zeros(len(out), np.uint64)
    for j in range(order, -1, -1):
        key[j:] |= out[: len(out) - j].astype(np.uint64) << np.uint64(8 * j)
    return key[out != START], offsets + np.arange(n + 1)


def of_block(table, order: int, limit: int = 2 << 20):
    """Per chunk of a block's texts: rows from, to, gram keys, keys before each text, word keys, words before each text."""
    for batch in table.combine_chunks().to_batches():
        at = batch.schema.get_field_index("text")
        for lo, hi, data, offsets in text_chunks(batch, at, limit):
            data = lower_ascii(data)
            starts, ends, first = word_spans(data, offsets)
            yield batch, lo, hi, *grams(data, offsets, order), word_hashes(data, starts, ends, 1), first


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((splitmix(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split(keys: np.ndarray, where: np.ndarray, *more: np.ndarray):
    """Arrays apart by `where`: (bucket, keys, ...), each in the order it had."""
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]]) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(where[order[a]]), *(x[order[a:b]] for x in (keys, *more))


def _planes(x: np.ndarray) -> bytes:
    """Compressed byte plane by byte plane: the high bytes of small numbers are zeros."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _numbers(blob: bytes, kind: type) -> np.ndarray:
    """_planes(), undone."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, packed as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def spread(blob: bytes) -> np.ndarray:
    """squeezed(), undone."""
    return np.cumsum(_numbers(blob, np.uint64), dtype=np.uint64)


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Doubles, of which many are equal: the distinct ones, and where each is among them."""
    distinct, place = np.unique(values, return_inverse=True)
    return _planes(distinct), _planes(place.astype(np.int32))


def uncoded(distinct: bytes, place: bytes) -> np.ndarray:
    return _numbers(distinct, np.float64)[_numbers(place, np.int32)]


def gathered(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """block, kind, bucket, keys, counts: a block's distinct keys, and how often its training texts have each."""
    import pyarrow as pa

    def run(table):
        found = {GRAM: [], WORD: []}
        for batch, lo, hi, gram, g_first, word, w_first in of_block(table, order):
            train = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)[lo:hi].astype(bool)
            for kind, keys, first in ((GRAM, gram, g_first), (WORD, word, w_first)):
                found[kind].append(tally(keys, np.repeat(train, np.diff(first))))
        rows = []
        block = table.column("block")[0].as_py()
        for kind, parts in found.items():
            keys, counts = add_up(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            rows += [(block, kind, b, squeezed(k), _planes(c.astype(np.int32))) for b, k, c in split(keys, bucket_of(keys, buckets), counts)]
        return pa.table(dict(zip(("block", "kind", "bucket", "keys", "counts"), zip(*rows))) if rows else {c: [] for c in ("block", "kind", "bucket", "keys", "counts")}, schema=schema)

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    return blocks.groupBy("block").applyInArrow(run, "block long, kind int, bucket long, keys binary, counts binary")


def by_bucket(rows: DataFrame, *then: str) -> DataFrame:
    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", *then)


def totals(sent: DataFrame) -> DataFrame:
    """kind, bucket, keys, counts, n (their sum), v (how many aren't 0) over all blocks; 0 for keys of held-out texts alone."""
    import pyarrow as pa

    names = ["kind", "bucket", "keys", "counts", "n", "v"]

    def out(at, keys, counts):
        values = [[at[0]], [at[1]], [squeezed(keys)], [_planes(counts)], [int(counts.sum())], [int((counts > 0).sum())]]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    def run(batches):
        at, parts, held, most = None, [], 0, 1 << 21

        def folded():
            return add_up(*(np.concatenate(x) for x in zip(*parts)))

        for batch in batches:
            for kind, bucket, keys, counts in zip(*(batch.column(i) for i in range(4))):
                now = (kind.as_py(), bucket.as_py())
                if now != at:
                    if at:
                        yield out(at, *folded())
                    at, parts, held, most = now, [], 0, 1 << 21
                parts.append((spread(keys.as_py()), _numbers(counts.as_py(), np.int32).astype(np.int64)))
                held += len(parts[-1][0])
                if held > most:
                    parts = [folded()]
                    held = len(parts[0][0])
                    most = max(1 << 21, 2 * held)
        if at:
            yield out(at, *folded())

    rows = by_bucket(sent).select("kind", "bucket", "keys", "counts")
    return rows.mapInArrow(run, "kind int, bucket long, keys binary, counts binary, n long, v long")


def triple_counts(all_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (two bytes before, byte) keys and their counts: at most 256**3 whatever the corpus, some 10**5 in texts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                triple, n = add_up(spread(keys.as_py()) & np.uint64(0xFFFFFF), _numbers(counts.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(triple.astype(np.int32)), pa.array(n)], ["triple", "n"])

    rows = all_.filter(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    found = rows.filter("n > 0").toArrow()
    keys, counts = found.column("triple").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def log_probabilities(keys: np.ndarray, counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 P(byte | context) of each key, by PPM with escape method D and symbol exclusion.

    keys: distinct; with every key that shares the three bytes before the predicted one with any of them. counts: in training, 0
    for keys to score only. triples: as of triple_counts(), for all keys; contexts up to two bytes long are there. order: 2 or more. A context gives a seen byte (2c - 1) / 2n and escape u / 2n, of u distinct bytes in n; bytes that a longer
    context has seen are left out of n and u of the shorter one. A context that training hasn't seen costs nothing.
    """
    seen = counts > 0
    level = [None] * (order + 1)
    k, c = add_up(keys[seen], counts[seen])
    for j in range(order, 1, -1):
        if j == 2:
            k, c = triples
        context = k >> np.uint64(8)
        at = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(k) else np.zeros(0, np.int64)
        level[j] = (k, c, context[at], np.add.reduceat(c, at) if len(at) else c[:0], np.diff(np.r_[at, len(k)]), at)
        k, c = add_up(k & np.uint64((1 << 8 * j) - 1), c)

    def find(sorted_, wanted):
        at = np.minimum(np.searchsorted(sorted_, wanted), max(len(sorted_) - 1, 0))
        return at, (sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), bool))

    one = np.zeros(1 << 16, np.int64)
    np.add.at(one, (triples[0] & np.uint64(0xFFFF)).astype(np.int64), triples[1])
    one = one.reshape(256, 256)
    zero = one.sum(axis=0)
    byte, before = (keys & np.uint64(255)).astype(int), (keys >> np.uint64(8) & np.uint64(255)).astype(int)
    score = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    # What the longer context, where seen, leaves out of the shorter one's n and u.
    out_n, out_u = np.zeros(len(keys)), np.zeros(len(keys))
    for j in range(order, -1, -1):
        if j > 1:
            k, c, contexts, n_of, u_of, at = level[j]
            ci, known = find(contexts, keys >> np.uint64(8) & np.uint64((1 << 8 * j) - 1))
            ki, hit = find(k, keys & np.uint64((1 << 8 * (j + 1)) - 1))
            n = np.where(known, n_of[ci] if len(n_of) else 0, 0).astype(float)
            u = np.where(known, u_of[ci] if len(u_of) else 0, 0).astype(float)
            count = np.where(hit, c[ki] if len(c) else 0, 0).astype(float)
        elif j == 1:
            n, u, count = one.sum(axis=1)[before].astype(float), (one > 0).sum(axis=1)[before].astype(float), one[before, byte].astype(float)
        else:
            n, u, count = np.full(len(keys), float(zero.sum())), np.full(len(keys), float((zero > 0).sum())), zero[byte].astype(float)
        known, hit = n > 0, count > 0
        left, kinds = n - out_n, u - out_u
        now = hit & ~done
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(now, score + np.log10((2 * count - 1) / (2 * left)), score)
            done |= hit
            escape = known & ~done & (kinds > 0)
            score = np.where(escape, score + np.log10(kinds / (2 * left)), score)
        if j > 0:
            # The bytes of this context, counted in the next shorter one.
            if j > 2:
                lower = level[j - 1]
                li, _ = find(lower[0], k & np.uint64((1 << 8 * j) - 1))
                below = np.add.reduceat(lower[1][li], at) if len(at) else n_of
                out_n = np.where(known, below[ci] if len(below) else 0, 0)
            elif j == 2:
                below = np.add.reduceat(one[(k >> np.uint64(8) & np.uint64(255)).astype(int), (k & np.uint64(255)).astype(int)], at) if len(at) else n_of
                out_n = np.where(known, below[ci] if len(below) else 0, 0)
            else:
                out_n = np.where(known, ((one > 0) * zero).sum(axis=1)[before], 0)
            out_u = np.where(known, u, 0)
    unseen = 256 - int((zero > 0).sum())
    return np.where(done, score, score - math.log10(max(unseen, 1)))


def model(all_: DataFrame, order: int, buckets: int) -> DataFrame:
    """kind, bucket, keys, values of all gram keys. Keys meet by the three bytes before the predicted one."""
    import pyarrow as pa

    triples = all_.sparkSession.sparkContext.broadcast(triple_counts(all_))

    def apart(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                keys, counts = spread(keys.as_py()), _numbers(counts.as_py(), np.int64)
                rows = list(split(keys, bucket_of(keys >> np.uint64(8) & np.uint64(0xFFFFFF), buckets), counts))
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([squeezed(r[1]) for r in rows], pa.binary()), pa.array([_planes(r[2]) for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["by", "keys", "counts"])

    def run(table):
        keys = np.concatenate([spread(k) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([_numbers(c, np.int64) for c in table.column("counts").to_pylist()])
        scores = log_probabilities(keys, counts, triples.value, order)
        at = np.argsort(keys)
        rows = list(split(keys[at], bucket_of(keys[at], buckets), scores[at]))
        return pa.table({
            "kind": pa.array([GRAM] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "keys": pa.array([squeezed(r[1]) for r in rows], pa.binary()), "values": pa.array([_planes(r[2]) for r in rows], pa.binary()),
        })

    met = all_.filter(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(apart, "by long, keys binary, counts binary")
    return met.groupBy("by").applyInArrow(run, "kind int, bucket long, keys binary, values binary")


def answered(sent: DataFrame, grams_: DataFrame, words: DataFrame) -> DataFrame:
    """block, kind, bucket, distinct, place: for each key that a block sent, in order, its value: log-probability, or a word's count."""
    import pyarrow as pa

    def run(batches):
        at, parts, table = None, [], None
        for batch in batches:
            found = []
            for kind, bucket, block, keys, values in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (kind, bucket) != at:
                    at, parts, table = (kind, bucket), [], None
                if block is None:  # what the bucket knows comes before what is asked of it
                    parts.append((spread(keys), _numbers(values, np.int64 if kind == WORD else np.float64).astype(np.float64)))
                    continue
                if table is None:
                    known, value = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(known)
                    table, parts = (known[order], value[order]), []
                found.append((block, kind, bucket, *coded(table[1][np.searchsorted(table[0], spread(keys))])))
            if found:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["block", "kind", "bucket", "distinct", "place"])

    none = F.lit(None).cast("long").alias("block")
    known = [df.select("kind", "bucket", none, "keys", F.col(c).alias("values")) for df, c in ((grams_, "values"), (words, "counts"))]
    asked = sent.select("kind", "bucket", "block", "keys", F.lit(None).cast("binary").alias("values"))
    return by_bucket(known[0].union(known[1]).union(asked), "block").mapInArrow(run, "block long, kind int, bucket long, distinct binary, place binary")


def scored(blocks: DataFrame, answers: DataFrame, order: int, buckets: int, n_docs: int, n_words: int, kinds: int) -> DataFrame:
    import pyarrow as pa

    n, v = n_words + n_docs, kinds + (n_docs > 0)
    floor = math.log10(n + 0.5 * (v + 1))

    def run(texts, known):
        import pyarrow.compute as pc

        chunks, parts = [], {GRAM: [], WORD: []}
        for batch, lo, hi, gram, g_first, word, w_first in of_block(texts, order) if texts.num_rows else ():
            own = []
            for kind, keys in ((GRAM, gram), (WORD, word)):
                distinct, place = np.unique(keys, return_inverse=True)
                parts[kind].append(distinct)
                own.append((distinct, place.astype(np.int32)))
            chunks.append((batch, lo, hi, own, g_first, w_first))
        table = {}
        for kind, found in parts.items():
            keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            value = np.zeros(len(keys))
            mine = known.filter(pc.equal(known.column("kind"), kind))
            by = dict(zip(mine.column("bucket").to_pylist(), zip(mine.column("distinct").to_pylist(), mine.column("place").to_pylist())))
            for b, at in split(np.arange(len(keys)), bucket_of(keys, buckets)):
                value[at] = uncoded(*by[b])
            table[kind] = keys, value

        def of(kind, distinct, place):
            keys, value = table[kind]
            return value[np.searchsorted(keys, distinct)][place] if len(place) else np.zeros(0)

        out = []
        for batch, lo, hi, (gram, word), g_first, w_first in chunks:
            score = np.add.reduceat(of(GRAM, *gram), g_first[:-1])
            count = of(WORD, *word)
            logs, sure = np.r_[0.0, np.cumsum(np.log10(count + 0.5) - floor)], np.r_[0, np.cumsum(count > 0)]
            words = np.diff(w_first)
            base = np.diff(logs[w_first]) + math.log10(n_docs + 0.5) - floor
            out.append(pa.table({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo),
                "held_out": batch.column(batch.schema.get_field_index("held_out")).slice(lo, hi - lo),
                "n_tokens": words + 1, "n_known": np.diff(sure[w_first]) + int(n_docs > 0), "train_tokens": np.full(hi - lo, n),
                "base_score": base, "score": score,
            }, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, order: int = ORDER, folds: int = 5, held: int = 1, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents with crc32 of doc_id (as text; null: empty) mod `folds` equal to `held`; counts are over all others.
    A-Z are lower-cased. Null text is empty: its tokens are the end alone. score is log10 of the probability that PPM gives to the
    bytes of the text and its end; base_score that of a word unigram with 0.5 added. Words and contexts are told apart by 64-bit
    keys. Without training documents every byte costs log10 of the alphabet. Columns besides doc_id and text are not read.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held
    given = given.withColumn("held_out", out)
    size = given.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks_n = max(1, math.ceil((size["bytes"] or 0) / block))
    blocks = given.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks_n)))
    buckets = max(1, min(BUCKETS, math.ceil((size["bytes"] or 0) / max(block, share))))
    sent = stored(gathered(blocks, order, buckets))
    all_ = stored(totals(sent))
    words = all_.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    answers = answered(sent, model(all_, order, buckets), all_.filter(F.col("kind") == WORD))
    return scored(blocks, answers, order, buckets, size["train"] or 0, words["n"], words["v"])
