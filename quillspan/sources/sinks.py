"""Sinks: logs, tables, documents, reports and markers."""

from __future__ import annotations

import fcntl
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append as JSON lines: new files beside the old ones, which the committer publishes whole."""
    df.write.mode("append").json(path)


def append_record(record: dict, path: str | Path) -> None:
    """Append one record as a JSON line to a file of this machine, under a lock that other writers of it keep too."""
    line = json.dumps(record, ensure_ascii=False) + "\n"
    with open(path, "a", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(line)
        f.flush()


def jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite with JSON lines, a folder for each value of ``by``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "append") -> None:
    """CSV with a header in every file."""
    w = df.write.mode(mode).option("header", True)
    (w.option("compression", "gzip") if gzip else w).csv(path)


def document(df: DataFrame) -> str:
    """Rows (a result table) as one JSON array; null fields are left out."""
    rows = df.select(F.to_json(F.struct("*")).alias("j")).collect()
    return "[\n " + ",\n ".join(r["j"] for r in rows) + "\n]\n"


def markdown(df: DataFrame, right: set[str] = frozenset()) -> str:
    """Rows (a result table) as a Markdown table; columns in ``right`` are set to the right, null is n/a."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in df.columns]
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("r")).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "|".join("---:" if c in right else "---" for c in df.columns) + "|"
    return "\n".join([head, *(r["r"] for r in rows)]) + "\n"


def fixed_width(df: DataFrame, widths: dict[str, int]) -> str:
    line = F.concat(*(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("n/a")), n, " ") for c, n in widths.items()))
    return "\n".join(["".join(c.rjust(n) for c, n in widths.items()), *(r[0] for r in df.select(line).collect())])


def spliced(text: str, name: str, block: str) -> str:
    """``text`` with what stands between the markers of ``name`` replaced; exactly one pair must be there."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
        raise ValueError(f"expected one pair of markers {name}")
    return text[: text.index(start) + len(start)] + "\n" + block.strip("\n") + "\n" + text[text.index(end) :]


def replaced_once(text: str, pattern: str, put: str) -> str:
    """``text`` with the only match of ``pattern`` replaced; an error for none or several."""
    out, n = re.subn(pattern, lambda m: put, text)
    if n != 1:
        raise ValueError(f"{n} matches of {pattern}")
    return out


def published(path: str | Path, content: str) -> None:
    """Write beside the target and move it into place, so readers see the old file or the new one."""
    path = Path(path)
    part = path.with_name(path.name + ".part")
    part.write_text(content, encoding="utf-8")
    os.replace(part, path)


def ids(df: DataFrame, key: str, path: str, one_file: bool = False) -> None:
    """One id a line, in order, over the sorted parts of a folder; ``one_file`` for a subset that is small."""
    rows = df.select(F.col(key).cast("long").alias("id")).orderBy("id").select(F.col("id").cast("string"))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)


def number_files(df: DataFrame, column: str, path: str, kind: str = "float") -> int:
    """The numbers of an array column as little-endian 32-bit files (``float`` or ``int``), one a task, rows one after the other in the order they have there; how many rows. ``readers.number_rows`` reads them. A task writes beside its file and renames it, so one that is run again leaves the same."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from quillspan.session import ship
    from quillspan.sources.answers import opened

    ship(df.sparkSession)
    form, end = {"float": ("<f4", "f32"), "int": ("<i4", "i32")}[kind]
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    hadoop.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(hadoop.Path(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = opened(path)
        name, n = f"part-{task.partitionId():05d}.{end}", 0
        part = f"{folder}/_{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(part) as f:
            for b in batches:
                n += len(b)
                f.write(np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), form).tobytes())
        fs.move(part, f"{folder}/{name}") if n else fs.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return df.select(column).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def done_if(df: DataFrame, expected: int, marker: str | Path) -> bool:
    """Write ``marker`` only if ``df`` has exactly the expected number of rows."""
    n = df.count()
    if n == expected:
        published(marker, f"{n}\n")
    return n == expected


def missing_jobs(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of a queue (``expected``: keys and expected) whose rows aren't exactly as many as expected: keys, expected, n."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return expected.join(have, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected").select(*keys, "expected", "n")


def run_queue(jobs: dict[str, Callable[[], DataFrame]], expected: dict[str, int], folder: str | Path) -> list[str]:
    """Run jobs in order, each once: one whose marker stands in ``folder`` is passed over, and a marker is set only where the rows are exactly as many as expected. The names of those that are not complete."""
    folder = Path(folder)
    return [name for name, job in jobs.items() if not (folder / f"{name}.done").exists() and not done_if(job(), expected[name], folder / f"{name}.done")]
