"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are four segments of 16.  Two fingerprints that differ in d <= 3 bits have, for some a, no error in
segment a and one at most in segment a+1 (mod 4): of the segments without error there is one at least; if it is alone, the
others have one error each; if there are two opposite ones, their successors share three errors, so one of them has one at
most; if two are adjacent, the second succeeds the first.  A segment is decoded, as a word of the perfect binary Golay code
(23, 12, 7) with zeros for the missing bits, to the index of the one codeword within three errors.  A fingerprint goes by one
key for each a and each codeword that segment a+1 or a word at one bit from it decodes to (six at most): two segments with
one error between them share a codeword.  A key is the number a, segment a as it is and the index, 30 bits in all.

Fingerprints are first made distinct.  A key's fingerprints are compared in one task up to BUCKET of them; larger ones are cut
into blocks of BUCKET and every two blocks are compared in a task of their own, so no pair is lost and no task is unbounded.
A task returns a spanning forest of the links it verified, never all pairs.

With several fingerprints and a larger distance the same keys find most similar texts but not all: see links().  A similarity
is then required of the texts themselves: their sets of shingles lie in files that workers read (Shelf), and a task tests what
it finds on them before it grows its forest, so that every link of the forest holds and none is left out for one that fails.
Texts with the same set are one node.

Edge cases: a null or blank text has the fingerprint 0 and is linked like any other; a text of fewer words than a shingle is
one shingle; repeated rows have the same component; a null id takes part but is never a component's id unless it has no
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import shutil
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, checkpointed, mix, only, partitions, shared_path
from .components import components

DISTANCE = 3
BUCKET = 4096
#: Keys of up to so many rows are compared in bulk.
SIFTED = 32
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of a UTF-8 text's word shingles, in order."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def fingerprints_of(h: np.ndarray, count: int = 1) -> list[int]:
    """64-bit SimHashes of shingle hashes: a bit is 1 if it is set in over half of them.

    The first takes the hashes as they are, the others mixed with a number.
    """
    n = len(h)
    if not n:
        return [0] * count
    out = []
    for r in range(count):
        planes = (mix(h + np.uint64(r * BASES[0] % 2**64)) if r else h).astype("<u8").view(np.uint8).reshape(n, 8)
        if n < 64:
            ones = np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0)
        else:
            ones = np.concatenate([np.bincount(planes[:, j], minlength=256) @ _BITS for j in range(8)])
        out.append(int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little"))
    return out


def fingerprint_text(text: bytes, width: int, count: int = 1) -> list[int]:
    """The SimHashes of a text's word shingles; a shingle counts as often as it stands there."""
    return fingerprints_of(shingle_hashes(text, width), count)


class Shelf:
    """Records of texts: their fingerprints and the sorted set of their shingles, by the upper HASH_BYTES of the hashes.

    A node is the number of a file, 36 bits up, and the record's place in it.  Records are read, not mapped, and CACHED bytes of
    them are held.
    """

    HASH_BYTES, FIRST_READ, CACHED, OPEN = 6, 2560, 16 << 20, 128

    def __init__(self, folder: str, count: int, similarity: float, share: float):
        self.folder, self.count, self.similarity, self.most = folder, count, similarity, int(share * 64 * count)
        self.files, self.records, self.held = OrderedDict(), OrderedDict(), 0

    @classmethod
    def record(cls, fps: list[int], distinct: np.ndarray) -> bytes:
        hashes = np.unique(distinct >> np.uint64(8 * (8 - cls.HASH_BYTES))).astype("<u8")
        return np.array([len(hashes), *fps], "<u8").tobytes() + hashes.view(np.uint8).reshape(-1, 8)[:, : cls.HASH_BYTES].tobytes()

    def _file(self, number: int) -> int:
        if number not in self.files:
            if len(self.files) >= self.OPEN:
                self.files.popitem(last=False)[1].close()
            self.files[number] = open(f"{self.folder}/{number}", "rb", buffering=0)  # closed with the shelf of the task
        return self.files[number].fileno()

    def read(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        found = self.records.get(node)
        if found is None:
            file, at = self._file(node >> 36), node & (1 << 36) - 1
            head, data = 8 * (1 + self.count), os.pread(file, self.FIRST_READ, at)
            fields = np.frombuffer(data[:head], "<u8")
            size = head + int(fields[0]) * self.HASH_BYTES
            while len(data) < size:
                data += os.pread(file, size - len(data), at + len(data))
            hashes = np.zeros((int(fields[0]), 8), np.uint8)
            hashes[:, : self.HASH_BYTES] = np.frombuffer(data, np.uint8, size - head, head).reshape(-1, self.HASH_BYTES)
            found = self.records[node] = fields[1:], hashes.view("<u8").reshape(-1)
            self.held += hashes.nbytes + 500
            while self.held > self.CACHED and len(self.records) > 2:
                self.held -= self.records.popitem(last=False)[1][1].nbytes + 500
        return found

    def similar(self, u: int, v: int) -> bool:
        """Whether u's and v's sets have the required part of their union in common; not asked if too many bits differ."""
        (fps_u, a), (fps_v, b) = self.read(u), self.read(v)
        if min(len(a), len(b)) < self.similarity * max(len(a), len(b)) - 1e-9 or int(np.bitwise_count(fps_u ^ fps_v).sum()) > self.most:
            return False
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        return common >= self.similarity * (len(both) - common) - 1e-9


def row_of(id_column: str, text_column: str) -> Column:
    """A hash of id and text: the same for rows alike in both, of which null texts are empty."""
    return F.xxhash64(F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = only(docs, id_column, text_column).toDF("id", "text")
    return rows.select("id", row_of("id", "text").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def shelved(docs: DataFrame, shelf: Shelf, width: int, id_column: str, text_column: str) -> DataFrame:
    """id, row, fps, content (a hash of the set of shingles) and node of every row; its record lies in a file of its task's own.

    A shingle counts once in these fingerprints.
    """
    rows = _rows(docs, id_column, text_column)
    folder, count = shelf.folder, shelf.count

    def task(batches):
        number, file = TaskContext.get().partitionId() << 8, None
        while file is None:  # another attempt may have left a file
            try:
                file = open(f"{folder}/{number}", "xb")
            except FileExistsError:
                number += 1
        with file:
            for batch in batches:
                fps, content, nodes = [], [], []
                for t in batch.column(2):
                    distinct = np.unique(shingle_hashes(t.as_py(), width))
                    fps.append(fingerprints_of(distinct, count))
                    content.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                    nodes.append(number << 36 | file.tell())
                    file.write(Shelf.record(fps[-1], distinct))
                file.flush()
                flat = np.array(fps, np.uint64).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * count), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(nodes, pa.int64())], ["id", "row", "fps", "content", "node"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, row long, fps array<long>, content long, node long")


def fingerprints(docs: DataFrame, width: int = 3, count: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, row and fps (the fingerprints as signed longs) of every row."""
    rows = _rows(docs, id_column, text_column)

    def task(batches):
        for batch in batches:
            fps = np.array([fingerprint_text(t.as_py(), width, count) for t in batch.column(2)], np.uint64).reshape(-1, count).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * count), pa.array(fps.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "row", "fps"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, row long, fps array<long>")


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: the remainder of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The upper 12 bits of the codeword within three errors of each 23-bit word."""
    singles = [1 << i for i in range(23)]
    errors = [0, *singles, *(a | b for i, a in enumerate(singles) for b in singles[:i]), *(a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j])]
    errors = np.array(errors, np.int64)
    by_syndrome = np.zeros(2048, np.int64)
    by_syndrome[_remainder(errors)] = errors
    return (words ^ by_syndrome[_remainder(words)]) >> 11


def ball_table() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment: the indices that it and the words at one bit from it decode to, padded by -1, and its own."""
    own = np.arange(1 << 16)
    near = np.stack([own, *(own ^ (1 << i) for i in range(16))])
    found = np.sort(codeword_index(near.reshape(-1)).reshape(near.shape), axis=0)
    found[1:][found[1:] == found[:-1]] = -1
    found = -np.sort(-found, axis=0)
    return found[: int((found >= 0).sum(axis=0).max())].T, codeword_index(own)


def _forest(fps: np.ndarray, groups: np.ndarray, distance: int, test=None) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that with the groups known before connect what all links among rows connect; no two of them link
    the same groups.  Trees grow from their first row.  test, if given, says of two positions whether they are a link."""
    left, u, v = np.arange(1, len(fps)), [], []
    queue = [0] if len(fps) and (groups != groups[0]).any() else []
    if not queue:
        left = left[:0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop(0)
        same = groups[left] == groups[at]
        near = (np.bitwise_count(fps[at] ^ fps[left]) <= distance) & ~same
        if test is not None:
            held = set()
            for j in np.flatnonzero(near).tolist():
                group = int(groups[left[j]])
                near[j] = group not in held and test(at, int(left[j]))
                if near[j]:
                    held.add(group)
        if not near.any():
            if same.any():
                queue += left[same].tolist()
                left = left[~same]
            continue
        found, first = np.unique(groups[left[near]], return_index=True)
        u += [at] * len(found)
        v += left[near][first].tolist()
        joined = np.isin(groups[left], np.append(found, groups[at]))
        queue += left[joined].tolist()
        left = left[~joined]
    return np.array(u, np.int64), np.array(v, np.int64)


LINKS = "u long, v long, w long, key long, block long"


def _compare(distance: int, bucket: int, split: bool, shelf: Shelf | None = None):
    """Over rows (key, fp, node, grp) sorted by key: links u, v of nodes of different groups within each key.  With split, the
    rows of keys of more than bucket rows come back instead, with the key and a block number: u is the fingerprint, v the node
    and w its group."""
    names = ["u", "v", "w", "key", "block"]

    def links_of(fps, nodes, groups):
        order = np.argsort(nodes)  # a group's links then mostly lead to one node, by whichever key they are found
        fps, nodes, groups = fps[order], nodes[order], groups[order]
        u, v = _forest(fps, groups, distance, shelf and (lambda a, b: shelf.similar(int(nodes[a]), int(nodes[b]))))
        nothing = np.zeros(len(u), np.int64)
        return [nodes[u], nodes[v], nothing, nothing - 1, nothing]

    def task(batches):
        key, held, block = None, [], 0

        def flush(done: bool):
            """What the rows held of the present key give; all of them if the key is done."""
            nonlocal held, block
            fps, nodes, groups = (np.concatenate(x) for x in zip(*held))
            held = []
            if split and (block or len(fps) > bucket):
                cut = len(fps) if done else len(fps) // bucket * bucket
                blocks = block + np.arange(cut) // bucket
                block += -(-cut // bucket)
                if cut < len(fps):
                    held = [(fps[cut:], nodes[cut:], groups[cut:])]
                return [fps[:cut].view(np.int64), nodes[:cut], groups[:cut], np.full(cut, key, np.int64), blocks]
            if not done:
                held = [(fps, nodes, groups)]
                return None
            return links_of(fps, nodes, groups)

        for batch in batches:
            keys, fps, nodes = (np.asarray(batch.column(i)) for i in range(3))
            groups = np.asarray(pc.coalesce(batch.column(3), batch.column(2)))
            fps = fps.view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            inner = np.ones(len(starts), bool)  # keys that this batch holds whole
            inner[-1] = False
            inner[0] &= keys[0] != key
            two = starts[inner & (sizes == 2)]
            two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance) & (groups[two] != groups[two + 1])]
            if shelf:
                two = two[[shelf.similar(int(nodes[i]), int(nodes[i + 1])) for i in two] if len(two) else []]
            # Keys of a few rows mostly have no link: they are sifted out all at once, by comparing rows at each distance.
            run, hit = np.repeat(np.arange(len(starts)), sizes), np.zeros(len(starts), bool)
            for k in range(1, min(int(sizes[inner].max(initial=0)), SIFTED)):
                at = np.flatnonzero(run[k:] == run[:-k])
                at = at[(np.bitwise_count(fps[at] ^ fps[at + k]) <= distance) & (groups[at] != groups[at + k])]
                hit[run[at]] = True
            nothing = np.zeros(len(two), np.int64)
            out = [[nodes[two], nodes[two + 1], nothing, nothing - 1, nothing]]
            for r in np.flatnonzero(~inner | ((sizes > 2) & (hit | (sizes > SIFTED)))):
                if keys[starts[r]] != key:
                    if held:
                        out.append(flush(True))
                    key, held, block = int(keys[starts[r]]), [], 0
                own = slice(starts[r], starts[r] + sizes[r])
                held.append((fps[own], nodes[own], groups[own]))
                if sum(len(x[0]) for x in held) > 2 * bucket:
                    out.append(flush(False))
            out = [x for x in out if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flush(True)], names)

    return task


def links(classes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, exact_bits: int = 16, shelf: Shelf | None = None) -> DataFrame:
    """classes: node (long), fps, and grp (long), what is known to be linked already.  Links of nodes of different groups, key by
    key a spanning forest of those at most distance bits apart in one of their fingerprints: u, v.  Up to DISTANCE bits none is missed; beyond that, those that share no key are.
    With a shelf, links are those that are similar besides."""
    n = partitions(classes.sparkSession)

    def keys(batches):
        ball = ball_table()[0]
        for batch in batches:
            out = []
            nodes, groups, count = np.asarray(batch.column(0)), np.asarray(batch.column(2)), len(batch.column(1).flatten()) // max(1, len(batch))
            alone = groups == nodes  # is not sent
            all_fps = np.asarray(batch.column(1).flatten()).view(np.uint64).reshape(len(batch), count)
            for r in range(count):
                fps = all_fps[:, r]
                segments = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
                for a in range(4):
                    near = ball[segments[(a + 1) % 4]]
                    row, col = np.nonzero(near >= 0)
                    exact = segments[a][row] & ((1 << exact_bits) - 1)
                    out.append(((4 * r + a) << 28 | exact << 12 | near[row, col], fps[row].view(np.int64), nodes[row], alone[row], groups[row]))
            for at in range(0, len(out), 4):
                key, fp, node, mask, grp = (np.concatenate(c) for c in zip(*out[at : at + 4]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(node), pa.array(grp, mask=mask)], ["key", "fp", "node", "grp"])

    keyed = classes.select("node", "fps", "grp").mapInArrow(keys, "key long, fp long, node long, grp long").repartition(n, "key").sortWithinPartitions("key")
    found = checkpointed(keyed.mapInArrow(_compare(distance, bucket, True, shelf), LINKS))
    # Keys with more rows than a task compares: every two blocks meet in a task of their own.
    hot = found.where("key >= 0")
    blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    pairs = hot.join(blocks, "key").select("key", "u", "v", "w", "block", other).select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.col("u").alias("fp"), F.col("v").alias("node"), F.col("w").alias("grp"))
    met = pairs.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(distance, bucket, False, shelf), LINKS)
    return found.where("key < 0").select("u", "v").union(met.select("u", "v"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = DISTANCE, count: int = 1, similarity: float | None = None, share: float = 1.0, bucket: int = BUCKET, exact_bits: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, row (see row_of), fps and component_id (the least id that links reach) of every row.

    count: fingerprints of each text, one link in any of which suffices.  similarity: if given, the part of the union of their
    shingles that linked texts must have in common; share: the part of all bits in which they may differ to be tested for it.
    """
    shelf = None if similarity is None else Shelf(shared_path(docs.sparkSession, "shingles"), count, similarity, share)
    if shelf:
        marked = checkpointed(shelved(docs, shelf, width, id_column, text_column))
        classes = checkpointed(marked.groupBy("content", "fps").agg(F.min("id").alias("least"), F.min("node").alias("node")))
    else:
        marked = checkpointed(fingerprints(docs, width, count, id_column, text_column).withColumn("content", F.xxhash64("fps")))
        node = F.col("fps")[0] if count == 1 else F.col("content")
        classes = checkpointed(marked.groupBy("content", "fps").agg(F.min("id").alias("least")).withColumn("node", node))

    # The first fingerprint finds most links of large groups; the others then only link what is apart still.
    first = classes.select("node", F.slice("fps", 1, 1).alias("fps"), F.col("node").alias("grp"))
    roots = components(links(first, distance, bucket, exact_bits, shelf))
    if count > 1:
        apart = classes.join(roots, "node", "left").select("node", F.slice("fps", 2, count - 1).alias("fps"), F.coalesce("root", "node").alias("grp"))
        more = links(apart, distance, bucket, exact_bits, shelf)
        roots = components(more.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    if shelf:
        shutil.rmtree(shelf.folder)
    rooted = classes.join(roots, "node", "left").select("content", "least", F.coalesce("root", "node").alias("root"))
    # As a column made anew the root is dealt out for the join on both sides, so that a large group can be split.
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").bitwiseXOR(F.lit(0)).alias("of"), "component_id")
    by_content = rooted.join(named, F.col("root") == F.col("of")).select("content", "component_id")
    return marked.join(by_content, "content").select("id", "row", "fps", "component_id")


#: 0.8 of the word 5-shingles in common; found by as many fingerprints, the bits one of them may differ in and the part of all bits.
SIMILAR = {"width": 5, "count": 8, "distance": 12, "similarity": 0.8, "share": 0.22, "exact_bits": 12}


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """docs with one document, that of the least id, of each near-duplicate group; all columns stay.

    Rows alike in id and text are one document.  Of a group without ids all different texts stay.
    """
    groups = near_duplicates(docs, id_column=id_column, text_column=text_column, **(how or SIMILAR))
    # Decided on hashes alone; the texts are shuffled once, and rows alike meet where the join has dealt them.
    kept = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("__row")).distinct()
    own = docs.withColumn("__row", row_of(id_column, text_column))
    return own.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
