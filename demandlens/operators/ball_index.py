"""An index of balls for exact nearest neighbours by cosine.

Vectors are scaled to length 1 and belong to the nearest of up to CENTRES centres; a centre's vectors are cut into rings of
equal width by their distance from it. No vector of a ring can be nearer to a query than the triangle inequality
allows, given the query's distance from the centre and the ring's least and greatest radius. A search reads the most
promising rings first, then a few more, then all that may still hold one of the k nearest: the farthest last, or never.

Neighbouring rings share a slot, of which there are at most SLOTS. A query is sent once to each slot that has a ring it reads, not once to each ring: what
moves grows with the queries and the vectors, not with their rings. Which rings of a slot a query reads is decided where it meets them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_folder, small_batches

#: The centres are fitted to the SAMPLE rows of smallest hash; every row is indexed. What reaches the driver and the tasks
#: is bounded by these: the sample, the centres, and one row a ring.
CENTRES, SAMPLE, RINGS = 256, 4096, 256
SLOTS, PAGE_BYTES = 256, 1 << 21  # slots have pages of about so many bytes of vectors
PACK = 2048  # queries of a pack
ROWS = 8  # pairs of a pack and a page that a task is given at once
BLOCK, CELLS = 128, 1 << 20  # queries that are multiplied with a page at once; bounds held at once; candidates looked at at once
SECOND = 32  # rings a query reads in its second round
_SLACK = 2e-9  # distances are rounded to nine places


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for r in rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def _mask(lists: pa.Array, rings: np.ndarray) -> np.ndarray:
    """Which of some rings (sorted) each list has."""
    out = np.zeros((len(lists), len(rings)), dtype=bool)
    values, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(rings, values), len(rings) - 1)
    ok = rings[at] == values
    out[row[ok], at[ok]] = True
    return out


def _limits(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.inf).to_numpy(zero_copy_only=False)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, PACK at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = PACK - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == PACK:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which have a direction at all."""
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(m, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        return np.where(ok[:, None], m / np.where(ok, norm, 1.0)[:, None], 0.0), ok


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of spherical k-means, the first centres at even steps through the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)] if len(sample) else sample
    for _ in range(6 if len(sample) else 0):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        fresh, ok = _units(sums)
        centres = np.where(ok[:, None], fresh, centres)
    return centres


def _apart(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from the centres."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ centres.T)))


@dataclass
class BallIndex:
    """Built once over all vectors, searched by any number of query tables."""

    spark: SparkSession
    centres: np.ndarray
    rings: np.ndarray  # of each ring: its number, its centre, vectors, least and greatest radius, first and last slot; the centre -1 has vectors without a direction
    pages: DataFrame | None  # slot, rows (id, ring as its place among the rings, vector as packed doubles, skills)

    @classmethod
    def build(cls, chunks: DataFrame, tags: DataFrame | None = None, centres: int = CENTRES, path: str | None = None) -> BallIndex:
        """chunks: id, embedding (null ones are left out); tags: chunk_id, skill_id. The pages are written to ``path``, by
        default below the shared folder until the program ends."""
        spark = chunks.sparkSession
        path = path or shared_folder(spark, "balls")
        owned = chunks.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        sample = owned.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        units, ok = _units(np.stack(sample.to_list())) if len(sample) else (np.zeros((0, 1)), np.zeros(0, dtype=bool))
        units = units[ok]
        # as many centres as a ball would have vectors, while the sample shows so many
        fitted = _centres(units, min(centres, max(1, int(np.sqrt(len(units))))))
        if tags is not None:
            owned = owned.join(tags.groupBy(F.col("chunk_id").alias("id")).agg(F.collect_set(F.col("skill_id").cast("long")).alias("skills")), "id", "left")
        else:
            owned = owned.withColumn("skills", F.lit(None).cast("array<bigint>"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column(1))
                u, has = _units(m)
                own, radius = np.full(len(m), -1), np.zeros(len(m))
                if has.any() and len(fitted):
                    far = _apart(u[has], fitted)
                    own[has] = far.argmin(axis=1)
                    radius[has] = far.min(axis=1)
                ring = np.where(own < 0, -1, own * RINGS + np.minimum(RINGS - 1, (radius * RINGS / 2).astype(int)))
                vectors = pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ring, pa.int32()), pa.array(radius), vectors, batch.column(2)], ["id", "ring", "radius", "vector", "skills"])

        kind = owned.schema["id"].dataType.simpleString()
        placed = owned.select("id", "embedding", "skills").mapInArrow(assign, f"id {kind}, ring int, radius double, vector binary, skills array<bigint>")
        placed.write.parquet(f"{path}/rows")
        rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        sizes = rows.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
        found = sizes.orderBy("ring").toPandas()  # at most CENTRES * RINGS + 1 rows
        number, n = found["ring"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)
        per_page = max(64, PAGE_BYTES // (8 * max(1, units.shape[1])))
        total = max(1, int(n.sum()))
        slots = min(SLOTS, -(-total // per_page))
        ends = np.cumsum(n)
        low, high = (ends - n) * slots // total, (ends - 1) * slots // total  # a ring larger than a slot is spread over several
        rings = np.column_stack([number, np.where(number < 0, -1, number // RINGS), n, found["least"], found["most"], low, high]).astype(float).reshape(-1, 7)
        places = spark.createDataFrame([(int(a), i, int(b), int(c)) for i, (a, b, c) in enumerate(zip(number, low, high))], "ring int, place int, low int, high int")
        share = F.pmod(F.xxhash64("id"), F.col("high") - F.col("low") + 1).cast("int")
        page = F.pmod(F.xxhash64("id", F.lit("page")), F.lit(-(-total // (slots * per_page))))
        packed = rows.join(F.broadcast(places), "ring").groupBy((F.col("low") + share).alias("slot"), page.alias("page")).agg(F.collect_list(F.struct("id", F.col("place").alias("ring"), "vector", "skills")).alias("rows"))
        packed.write.parquet(f"{path}/pages")
        return cls(spark, fitted, rings, spark.read.schema(packed.schema).parquet(f"{path}/pages"))

    def bounds(self, units: np.ndarray, ok: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and ring (all, or some by place): the least cosine distance that a vector of the ring can have, and how far its centre is."""
        own, least, most = (self.rings if some is None else self.rings[some]).T[[1, 3, 4]]
        if len(self.centres):
            d = _apart(units, self.centres)[:, np.maximum(own, 0).astype(int)]
        else:
            d = np.zeros((len(units), len(own)))
        gap = np.maximum(0.0, np.maximum(d - most - 1e-9, least - d - 1e-9))
        return np.where((own < 0) | ~ok[:, None], 1.0, gap * gap / 2), d

    def _reads(self, batch: pa.RecordBatch, boost: float, some: np.ndarray | None = None) -> np.ndarray:
        """Which rings (all, or some by place) each query of a batch (id, vector, skill, limit, done, now) reads: those in ``now``, or where that is null all
        that aren't in ``done`` and may have a vector within the limit."""
        places = np.arange(len(self.rings)) if some is None else some
        if batch.column(5).null_count == 0:
            return _mask(batch.column(5), places)
        bound, _ = self.bounds(*_units(_packed(batch.column(1))), some)
        return (bound - boost <= _limits(batch.column(3))[:, None] + _SLACK) & ~_mask(batch.column(4), places)

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """So many queries at once that their bounds of all rings are at most CELLS."""
        size = max(1, CELLS // max(1, len(self.rings)))
        for batch in _gathered(batches):
            for i in range(0, batch.num_rows if len(self.rings) else 0, size):
                yield batch.slice(i, size)

    def _over(self, rows: DataFrame, work: Callable[[BallIndex, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        known = self.spark.sparkContext.broadcast((self.centres, self.rings))
        return rows.mapInArrow(lambda batches: work(BallIndex(None, *known.value, None), batches), schema)  # type: ignore[arg-type]

    def _chosen(self, asked: DataFrame, k: int, boost: float, first: bool) -> DataFrame:
        """``asked`` with the rings (by place) to be read now: those that are nearest until k vectors are read, or SECOND more."""

        def choose(index: BallIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = index.rings[:, 2]
            for batch in index._blocks(batches):
                bound, d = index.bounds(*_units(_packed(batch.column(1))))
                order = np.argsort(bound + 1e-6 * d, axis=1, kind="stable")
                if first:
                    read = np.cumsum(total[order], axis=1) - total[order] < k
                else:
                    own = (bound - boost <= _limits(batch.column(3))[:, None] + _SLACK) & ~_mask(batch.column(4), np.arange(len(index.rings)))
                    read = np.take_along_axis(own, order, axis=1)
                    read &= np.cumsum(read, axis=1) <= SECOND
                now = _lists([o[r] for o, r in zip(order.astype(np.int32), read)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], now], ["id", "vector", "skill", "limit", "done", "now"])

        kind = asked.schema["id"].dataType.simpleString()
        return self._over(asked.select("id", "vector", "skill", "limit", "done"), choose, f"id {kind}, vector binary, skill bigint, limit double, done array<int>, now array<int>")

    def _packs(self, asked: DataFrame, boost: float) -> DataFrame:
        """Packs of queries for each slot with a ring that they read."""

        def pack(index: BallIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = index.rings[:, 5].astype(int), index.rings[:, 6].astype(int)
            for whole in _gathered(batches):
                own: dict[int, list[np.ndarray]] = {}
                size = max(1, CELLS // max(1, len(low)))
                for start in range(0, whole.num_rows if len(low) else 0, size):
                    q, ring = np.nonzero(index._reads(whole.slice(start, size), boost))
                    touched = np.zeros((min(size, whole.num_rows - start), high.max() + 1), dtype=bool)
                    for more in range((high - low).max() + 1):
                        has = low[ring] + more <= high[ring]
                        touched[q[has], low[ring[has]] + more] = True
                    for slot in np.flatnonzero(touched.any(axis=0)):
                        own.setdefault(int(slot), []).append(start + np.flatnonzero(touched[:, slot]))
                queries = pa.StructArray.from_arrays(whole.columns, whole.schema.names)
                for slot, at in own.items():
                    taken = queries.take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)], ["slot", "queries"])

        kind = asked.schema["id"].dataType.simpleString()
        return self._over(asked, pack, f"slot int, queries array<struct<id: {kind}, vector: binary, skill: bigint, limit: double, done: array<int>, now: array<int>>>")

    def _read(self, asked: DataFrame, k: int, boost: float) -> DataFrame:
        """query_id, chunk_id, distance, tagged: the k best of each page and query, as far as they are within the query's limit."""

        def product(index: BallIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked, rows = (pa.RecordBatch.from_struct_array(batch.column(c).slice(i, 1).flatten()) for c in (0, 1))
                    rows = rows.take(pc.sort_indices(rows.column(0)))
                    ring, vectors = rows.column(1).to_numpy(), _packed(rows.column(2))
                    units, norms = _units(vectors)[0], np.linalg.norm(vectors, axis=1)
                    some, ring = np.unique(ring, return_inverse=True)
                    lengths = rows.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    skills, holder = rows.column(3).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(rows)), lengths)
                    for start in range(0, len(asked), BLOCK):
                        queries = asked.slice(start, BLOCK)
                        q, limit = _packed(queries.column(1)), _limits(queries.column(3))
                        reads = index._reads(queries, boost, some)
                        at = np.flatnonzero(reads.any(axis=0)[ring])  # vectors that some query of the block reads
                        if not len(at):
                            continue
                        # the queries' skills by number; 0 is none
                        known, code = np.unique(queries.column(2).drop_null().to_numpy(), return_inverse=True)
                        codes = np.zeros(len(q), dtype=int)
                        codes[queries.column(2).is_valid().to_numpy(zero_copy_only=False)] = code + 1
                        has = np.zeros((len(known) + 1, len(rows)), dtype=bool)
                        place = np.minimum(np.searchsorted(known, skills), max(0, len(known) - 1))
                        same = known[place] == skills if len(known) else np.zeros(len(skills), dtype=bool)
                        has[place[same] + 1, holder[same]] = True
                        near = _units(q)[0] @ units[at].T
                        if boost:
                            near += (boost * has[:, at])[codes]
                        row, column = np.nonzero((near >= 1 - limit[:, None] - 2 * _SLACK) & reads[:, ring[at]])
                        column = at[column]
                        far = np.empty(len(row))
                        own = np.linalg.norm(q, axis=1)
                        for part in range(0, len(row), CELLS // 16):
                            r, c = row[part : part + CELLS // 16], column[part : part + CELLS // 16]
                            with np.errstate(all="ignore"):
                                far[part : part + len(r)] = np.round(1 - np.einsum("ij,ij->i", q[r], vectors[c]) / (own[r] * norms[c]), 9)
                        far = np.where(np.isfinite(far), far, 1.0)
                        tagged = has[codes[row], column]
                        adjusted = np.round(far - boost * tagged, 9)
                        order = np.lexsort((column, adjusted, row))
                        row, column, far, tagged, adjusted = (x[order] for x in (row, column, far, tagged, adjusted))
                        best = np.arange(len(row)) - np.searchsorted(row, row) < k
                        best &= adjusted <= limit[row] + _SLACK
                        yield pa.RecordBatch.from_arrays(
                            [queries.column(0).take(pa.array(row[best])), rows.column(0).take(pa.array(column[best])), pa.array(far[best]), pa.array(tagged[best])], ["query_id", "chunk_id", "distance", "tagged"]
                        )

        kinds = [asked.schema["id"].dataType.simpleString(), self.pages.schema["rows"].dataType.elementType["id"].dataType.simpleString()]
        met = self._packs(asked, boost).join(self.pages, "slot").select("queries", "rows")
        return self._over(met, product, f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double, tagged boolean")

    def _counted(self, asked: DataFrame, boost: float, number: int) -> DataFrame:
        def count(index: BallIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in index._blocks(batches):
                n = index._reads(batch, boost).sum(axis=0)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(n[at], pa.int64()), pa.array(index.rings[at, 0].astype(np.int32))], ["queries", "ring"])

        return self._over(asked, count, "queries long, ring int").select(F.lit(number).alias("round"), "queries", "ring")

    def search(self, queries: DataFrame, k: int, boost: float = 0.0, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The k nearest vectors of each query (query_id, chunk_id, distance, tagged, adjusted, place), exactly, and what was
        read: round, queries, ring.

        queries: id, embedding, skill_id (may be missing). Distances are rounded to 9 places before they are compared, ties go
        to the lower id; a vector of the query's skill counts as ``boost`` nearer. Vectors without a direction have distance 1 from all.
        Three rounds: rings until k vectors are read; SECOND more; all that may still matter. Each is written below the shared folder.
        """
        path = path or shared_folder(self.spark, "search")
        packed = F.col("embedding").cast("array<double>")
        skill = F.col("skill_id").cast("long") if "skill_id" in queries.columns else F.lit(None).cast("long")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in _matrix(batch.column(1))], pa.binary()), batch.column(2)], ["id", "vector", "skill"])

        def saved(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{path}/{name}")

        kind = queries.schema["id"].dataType.simpleString()
        asked = queries.where("embedding IS NOT NULL").select("id", packed.alias("embedding"), skill.alias("skill")).mapInArrow(pack, f"id {kind}, vector binary, skill bigint")
        asked = asked.withColumns({"limit": F.lit(None).cast("double"), "done": F.lit(None).cast("array<int>")})
        adjusted = F.round(F.col("distance") - F.when(F.col("tagged"), boost).otherwise(0.0), 9)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("adjusted", "chunk_id"))
        best, read = None, None
        for number in range(3):
            if number < 2:
                asked = saved(self._chosen(asked, k, boost, number == 0), f"asked-{number}")
            else:
                asked = asked.withColumn("now", F.lit(None).cast("array<int>"))
            met = self._read(asked, k, boost).withColumn("adjusted", adjusted)
            with small_batches(self.spark, ROWS):
                best = saved((met if best is None else best.drop("place").unionByName(met)).withColumn("place", place).where(F.col("place") <= k), f"{number}")
            seen = self._counted(asked, boost, number)
            read = seen if read is None else read.unionByName(seen)
            worst = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("adjusted")).alias("worst"))
            done = F.concat(F.coalesce("done", F.array().cast("array<int>")), "now").alias("done")
            asked = asked.join(worst, "id", "left").select("id", "vector", "skill", F.col("worst").alias("limit"), done)
        return best, read
