"""Filling containers of fixed capacity with texts (problem 7), by bounded-space best fit.

Each packer takes the texts of its partition one after the other and keeps at most OPEN containers open for every
capacity. A text goes where the least room stays; where none has room, the fullest container is closed for a new
one. What is still open at the end is merged, FAN packers at a time. A text is cut only if it alone exceeds the
capacity: into full containers, and a rest that is placed like any other text.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.session import materialize

#: Containers a packer keeps open, texts of a packer, and packers whose leftovers are merged together.
OPEN, TEXTS, FAN = 32, 50_000, 64
#: Capacities are a table of settings; more than this many are refused.
MOST_SPECS = 1_000


def best_fit(sizes: Iterator[tuple[int, int]] | list[tuple[int, int]], capacity: int, most_open: int | None) -> Iterator[tuple[list[int], bool]]:
    """(members, leftover) of each container, for (member, size) in turn; sizes are at most ``capacity``.

    With ``most_open`` the containers open at the end are leftovers; without, any number stays open and none is.
    """
    room: list[tuple[int, int]] = []  # (room left, container), in order
    held: dict[int, list[int]] = {}
    number = 0
    for member, size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, container = room.pop(at)
        else:
            if most_open is not None and len(room) >= most_open:
                yield held.pop(room.pop(0)[1]), False
            left, container = capacity, number
            held[container] = []
            number += 1
        held[container].append(member)
        if left > size:
            insort(room, (left - size, container))
        else:
            yield held.pop(container), False
    for _, container in room:
        yield held.pop(container), most_open is not None


def capacities(specs: DataFrame, name_column: str, capacity_column: str) -> dict[str, int]:
    rows = specs.select(F.col(name_column).alias("name"), F.col(capacity_column).cast("int").alias("capacity")).dropna().filter("capacity > 0").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    return {r["name"]: r["capacity"] for r in rows}


def pack(sized: DataFrame, specs: dict[str, int], open_containers: int = OPEN, texts: int = TEXTS) -> DataFrame:
    """(spec_name, id, piece_no, first_token, tokens, container_id) of (id, tokens).

    Texts of no token (null, empty) take no room: their container is null. Repeated rows are texts of their own.
    Every other token of every text is in exactly one container of each capacity. An empty table gives no rows.
    """
    schema = T.StructType([
        T.StructField("spec_name", T.StringType()), T.StructField("id", sized.schema["id"].dataType), T.StructField("piece_no", T.IntegerType()),
        T.StructField("first_token", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("container_id", T.StringType()), T.StructField("leftover", T.BooleanType()),
    ])
    packers = max(1, math.ceil(sized.count() / texts))
    dealt = sized.select("id", "tokens").repartition(packers, F.xxhash64("id")).sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        packer = TaskContext.get().partitionId()
        ids = pa.chunked_array([b.column(0) for b in batches]).combine_chunks()
        sizes = [x or 0 for b in batches for x in b.column(1).to_pylist()]
        for name, capacity in specs.items():
            rows, piece, first, tokens, container, leftover = [], [], [], [], [], []

            def put(row: int, no: int, start: int, size: int, where: str | None, left: bool) -> None:
                for column, value in zip((rows, piece, first, tokens, container, leftover), (row, no, start, size, where, left)):
                    column.append(value)

            number = 0
            parts: list[tuple[int, int, int]] = []
            for row, size in enumerate(sizes):
                no, start = 1, 0
                while size - start > capacity:
                    put(row, no, start, capacity, f"{name}-{packer}-{number}", False)
                    number, no, start = number + 1, no + 1, start + capacity
                if size:
                    parts.append((row, no, start))
                else:
                    put(row, 1, 0, 0, None, False)
            for members, left in best_fit(((k, sizes[row] - start) for k, (row, _, start) in enumerate(parts)), capacity, open_containers):
                for k in members:
                    row, no, start = parts[k]
                    put(row, no, start, sizes[row] - start, f"{name}-{packer}-{number}", left)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(tokens, pa.int64()), pa.array(container, pa.string()), pa.array(leftover, pa.bool_())],
                schema.names,
            )

    packed = materialize(dealt.mapInArrow(run, schema), "packed")
    done = packed.filter("NOT leftover").drop("leftover")
    if packers == 1:
        return packed.drop("leftover")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        name, capacity = key[0].as_py(), specs[key[0].as_py()]
        fill: dict[str, int] = {}
        for where, size in zip(rows["container_id"].to_pylist(), rows["tokens"].to_pylist()):
            fill[where] = fill.get(where, 0) + size
        order = sorted(fill, key=lambda c: (-fill[c], c))
        new = {}
        for no, (members, _) in enumerate(best_fit([(k, fill[c]) for k, c in enumerate(order)], capacity, None)):
            new |= {order[k]: f"{name}-m{key[1].as_py()}-{no}" for k in members}
        return rows.drop_columns(["group", "leftover"]).set_column(5, "container_id", pa.array([new[c] for c in rows["container_id"].to_pylist()], pa.string()))

    # A group holds at most FAN * OPEN containers, whatever the size of the corpus.
    group = F.floor(F.split("container_id", "-")[F.size(F.split("container_id", "-")) - 2].cast("int") / FAN)
    merged = packed.filter("leftover").withColumn("group", group).groupBy("spec_name", "group").applyInArrow(merge, T.StructType(schema.fields[:-1]))
    return done.unionByName(merged)


def fill_rates(packed: DataFrame, specs: dict[str, int]) -> DataFrame:
    """(spec_name, capacity_tokens, containers, tokens, fill): how full the containers of each capacity are."""
    known = F.create_map(*[F.lit(x) for pair in specs.items() for x in pair]) if specs else F.lit(None)
    per = packed.filter("container_id IS NOT NULL").groupBy("spec_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.withColumn("capacity_tokens", F.element_at(known, F.col("spec_name"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
