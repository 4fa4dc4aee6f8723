"""Helpers shared by the operators: written tables, window hashes, key filters, streams of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import shared_path


ROWS_A_BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ROWS_A_BATCH rows: rows here are whole texts, and
    the default of 10,000 of them would be what fills a Python worker's memory.  A smaller setting stands."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_A_BATCH:
        conf.set(name, str(ROWS_A_BATCH))
    return df


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PARTITIONS_A_FILE = 16


def few_files(df: DataFrame) -> DataFrame:
    """``df``, a table that is small beside the input, dealt out evenly for writing: a file for every PARTITIONS_A_FILE shuffle partitions.

    Tasks start processes (chmod) for each file on a local path, and a file for each task that has a few rows would hold little.
    More partitions make more files, so a file's share of a growing table stays the same."""
    return df.repartition(max(1, shuffle_width(df.sparkSession) // PARTITIONS_A_FILE))


_KEPT: dict = {}


def kept_by_worker(name: str, make):
    """What a Python worker keeps over its tasks: one thing at a time, so that operators which follow each
    other in the same workers do not add up their memory."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (spreads low and high bits)."""
    h = (h ^ (h >> _S32)) * _MIX
    h = (h ^ (h >> _S32)) * _MIX
    return h ^ (h >> _S32)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` codes: a polynomial in 64-bit arithmetic, doubled up by
    halves (O(log width) array operations), then scrambled."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        run, length, power = codes, 1, _ODD
        out, done, out_power = None, 0, np.uint64(1)
        w = width
        while w:
            if w & 1:
                if out is None:
                    out = run
                else:
                    keep = min(len(out), len(run) - done)
                    out = out[:keep] * power + run[done:done + keep]
                out_power = out_power * power
                done += length
            w >>= 1
            if w:
                keep = len(run) - length
                run = run[:keep] * power + run[length:length + keep]
                power = power * power
                length *= 2
        return mixed(out[:n] + np.uint64(width))


def column_bytes(batch: pa.RecordBatch, name: str) -> list:
    """Values of a string or binary column as bytes (None for null)."""
    col = batch.column(name)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return col.to_pylist()


def longs(batch: pa.RecordBatch, name: str, null: int) -> np.ndarray:
    col = batch.column(name)
    return col.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


MOST_BITS = 26
SEGMENT = 1 << 18


def key_filter(keys: DataFrame, col: str) -> np.ndarray:
    """Bloom filter of the longs in a column of a written table: about 16 bits a key, 2^26 bits (8 MB) at most.

    Tasks send the bits that their own keys set, as places or as a bit array, whichever is shorter; Spark combines
    them by segment, and the driver gets the combined segments.  More keys make it pass more rows, never fewer."""
    log_bits = min(MOST_BITS, max(18, int(16 * keys.count()).bit_length()))

    def rows(batches):
        held = [np.empty(0, np.int64)]
        for batch in batches:
            held.append(np.unique(np.concatenate([held.pop(), *_places(batch.column(0).to_numpy(), log_bits)])))
        at = held[0]
        cut = np.flatnonzero(np.concatenate([[True], at[1:] // SEGMENT != at[:-1] // SEGMENT, [True]])) if len(at) else []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            k, inside = int(at[lo]) // SEGMENT, at[lo:hi] % SEGMENT
            if len(inside) * 4 < SEGMENT // 8:
                places, bits = inside.astype(np.int32).tobytes(), None
            else:
                set_ = np.zeros(SEGMENT, bool)
                set_[inside] = True
                places, bits = None, np.packbits(set_).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([places], pa.binary()), pa.array([bits], pa.binary())], ["segment", "places", "bits"])

    def merged(batches):
        for k, g in grouped_stream(batches, "segment", ["places", "bits"]):
            both = np.zeros(SEGMENT // 8, np.uint8)
            set_ = np.zeros(SEGMENT, bool)
            for places, bits in zip(g["places"], g["bits"], strict=True):
                if bits is None:
                    set_[np.frombuffer(places, np.int32)] = True
                else:
                    both |= np.frombuffer(bits, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(both | np.packbits(set_)).tobytes()], pa.binary())], ["segment", "bits"])

    parts = (keys.select(col).mapInArrow(rows, "segment int, places binary, bits binary").repartition(16, "segment").sortWithinPartitions("segment")
             .mapInArrow(merged, "segment int, bits binary").collect())
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for r in parts:
        out[r["segment"] * (SEGMENT // 8):(r["segment"] + 1) * (SEGMENT // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _places(keys: np.ndarray, log_bits: int):
    h = mixed(keys.view(np.uint64))
    return [(h & np.uint64((1 << log_bits) - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64((1 << log_bits) - 1)).astype(np.int64)]


def passing_rows(col: str, bits: np.ndarray):
    """:func:`passing` over Arrow batches, for a Python step that goes on with the rows itself."""
    log_bits = int(len(bits)).bit_length() + 2

    def rows(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at in _places(batch.column(col).to_numpy(), log_bits):
                keep &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows


def passing(df: DataFrame, col: str, bits: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter: a join with the keys then shuffles little else."""
    return df.mapInArrow(passing_rows(col, bits), df.schema)


def grouped_stream(batches, key: str, columns: list[str]):
    """(key, {column: list of values}) for rows that arrive sorted by ``key``."""
    now, held = None, {c: [] for c in columns}
    for batch in batches:
        keys = batch.column(key).to_pylist()
        if not keys:
            continue
        values = {c: batch.column(c).to_pylist() for c in columns}
        at = 0
        while at < len(keys):
            k = keys[at]
            end = at
            while end < len(keys) and keys[end] == k:
                end += 1
            if k != now and held[columns[0]]:
                yield now, held
                held = {c: [] for c in columns}
            now = k
            for c in columns:
                held[c].extend(values[c][at:end])
            at = end
    if held[columns[0]]:
        yield now, held


def row_key(*cols: str):
    """64-bit key of a row from its columns, nulls included (rows with equal values share it)."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def let(value, body):
    """``body`` of a column that is computed once a row, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns; clashing extra columns of the input never get further."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
