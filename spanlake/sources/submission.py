"""Nested submissions: one JSON object of any size, written as ordered fragments and joined by a commit step.

Predictions are range-partitioned by (results, clip, rank), so a large clip spreads over tasks. Each task writes its
rows as one fragment of the object's text and reports which clip it begins and ends with. The commit step writes the head, the seams between
fragments and the tail, and copies the fragments in between in blocks of bounded size; then the finished file takes
its place. Every attempt has a fragment of its own and only reported ones are used, so repeated tasks do no harm.

Each prediction stands on a line of its own, as does each clip's name. That is still one JSON object, and it lets the file be
read by many tasks. A reader's task fills section and clip forward over the lines of its file split; what a split's first
lines need comes from the last names in earlier splits, one row per split, so no line is sorted or shuffled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from spanlake.session import shuffle_width, spread

SECTIONS = ("detect_results", "retrieve_results")
BLOCK = 4 << 20


def file_system(path: str):
    """File system and plain path of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def seam(before: tuple[int, str] | None, after: tuple[int, str] | None) -> str:
    """Text between a row of one (section, clip) and a row of the next; None stands for the head and the tail."""
    if before is not None and before == after:
        return ",\n"
    out = "\n]" if before is not None else ""
    section = before[0] if before is not None else 0
    last = after[0] if after is not None else len(SECTIONS) - 1
    fresh = before is None
    while section < last:
        section += 1
        out += f'\n}}, "{SECTIONS[section]}": {{'
        fresh = True
    if after is None:
        return out + "\n}}\n"
    return out + ("\n" if fresh else ",\n") + json.dumps(after[1]) + ": [\n"


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    path: str
    first: tuple[int, str] | None
    last: tuple[int, str] | None


def changes(columns: list[pa.Array]) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal rows."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    at = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return list(zip(at[:-1], at[1:], strict=True)) if len(columns[0]) else []


class SubmissionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.head = {k: options[k] for k in ("version", "challenge")}
        self.stage = f"{self.path}.fragments-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Fragment:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, stage = file_system(self.stage)
        fs.create_dir(stage)
        own = f"{stage}/{task.partitionId()}-{task.taskAttemptId()}"
        first = last = None
        with fs.open_output_stream(own) as out:
            for b in batches:
                runs, text = changes([b["section"], b["clip"]]), []
                lists = pa.ListArray.from_arrays(pa.array([i for i, _ in runs] + [b.num_rows], pa.int32()), b["item"].cast(pa.binary()))
                for (i, _), items in zip(runs, pc.binary_join(lists, b",\n").to_pylist(), strict=True):
                    place = (b["section"][i].as_py(), b["clip"][i].as_py())
                    if first is None:
                        first = place
                    else:
                        text.append(seam(last, place).encode())
                    text.append(items)
                    last = place
                out.write(b"".join(text))
        return Fragment(task.partitionId(), own, first, last)

    def commit(self, messages: list[Fragment | None]) -> None:
        fs, path = file_system(self.path)
        done = f"{path}.{uuid.uuid4().hex}"
        found = sorted((m for m in messages if m is not None and m.first is not None), key=lambda m: m.partition)
        with fs.open_output_stream(done) as out:
            out.write(f'{json.dumps(self.head)[:-1]}, "{SECTIONS[0]}": {{'.encode())
            last = None
            for m in found:
                out.write(seam(last, m.first).encode())
                with fs.open_input_stream(m.path) as part:
                    while block := part.read(BLOCK):
                        out.write(block)
                last = m.last
            out.write(seam(last, None).encode())
        fs.move(done, path)
        self.clear()

    def abort(self, messages: list[Fragment | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow.fs import FileType

        fs, stage = file_system(self.stage)
        if fs.get_file_info(stage).type == FileType.Directory:
            fs.delete_dir(stage)


class SubmissionSource(DataSource):
    """Sink `submission`: rows (section int, clip string, item string), sorted over all partitions, as one nested object."""

    @classmethod
    def name(cls) -> str:
        return "submission"

    def schema(self) -> str:
        return "section int, clip string, item string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SubmissionWriter(self.options)


def submission_rows(detect: DataFrame, retrieve: DataFrame | None = None) -> DataFrame:
    """(section, clip, item) of predictions (clip_id, pred_id, label, score, t_start, t_end), sorted; best first in a clip.

    Without retrieval results the detections stand in both sections. A null clip_id has the name "null"; null fields are null.
    """
    def of(pred: DataFrame, sections: list[int]) -> DataFrame:
        clip = F.coalesce(F.col("clip_id").cast("string"), F.lit("null"))
        once = spread(pred).select(clip.alias("clip"), (-F.col("score")).alias("o"), F.col("pred_id").alias("i"), "label", "t_start", "t_end")
        # section and clip as one string: a sort looks at the first bytes of its first column alone before it compares rows
        return once.select(F.explode(F.array([F.concat(F.lit(str(k)), "clip") for k in sections])).alias("place"), *once.columns[1:])

    rows = of(detect, [0, 1]) if retrieve is None else of(detect, [0]).unionByName(of(retrieve, [1]))
    order = ["place", "o", "i", "label", "t_start", "t_end"]
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the text is made behind the sort, so it is neither sampled, nor shuffled, nor compared
    item = F.to_json(F.struct("label", (-F.col("o")).alias("score"), F.array("t_start", "t_end").alias("segment")), {"ignoreNullFields": "false"})
    return ranged.select(F.substring("place", 1, 1).cast("int").alias("section"), F.expr("substring(place, 2)").alias("clip"), item.alias("item"))


def write_submission(detect: DataFrame, path: str, retrieve: DataFrame | None = None, version: str = "1.0", challenge: str = "moment_queries") -> None:
    """Write {version, challenge, detect_results, retrieve_results} to the file at path, each results a map clip -> predictions."""
    detect.sparkSession.dataSource.register(SubmissionSource)
    rows = submission_rows(detect, retrieve)
    rows.write.format("submission").mode("append").option("version", version).option("challenge", challenge).save(path)


RESULT = "map<string, array<struct<label: string, score: double, segment: array<double>>>>"


def filled(marked: DataFrame, ends: bool) -> DataFrame:
    """(file, block, s, c, item): items with the last section s and clip c above them in their file split.

    Only where one of the two is missing are file and block, which name the split, given. ends asks for the last section and
    clip of every split instead, items null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = None, [None, None]

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*split, *held, None), kinds, strict=True)], names)

        for b in batches:
            names, kinds = b.schema.names, b.schema.types
            # the lines of a split stand together, so one look at both ends tells most batches
            same = b.num_rows and b["block"][0] == b["block"][-1] and b["file"][0] == b["file"][-1]
            for i, j in [(0, b.num_rows)] if same else changes([b["block"], b["file"]]):
                part = b.slice(i, j - i)
                here = (part["file"][0].as_py(), part["block"][0].as_py())
                if here != split:
                    if ends and split:
                        yield end()
                    split, held = here, [None, None]
                above = [pc.fill_null_forward(pa.concat_arrays([pa.array([h], part[c].type), part[c]]))[1:] for c, h in zip(("s", "c"), held, strict=True)]
                held = [x[-1].as_py() for x in above]
                if not ends:
                    # an item that has both needs nothing from earlier splits, so it names none
                    k = max(x.null_count for x in above)
                    place = [pa.concat_arrays([part[c][:k], pa.nulls(j - i - k, part[c].type)]) for c in ("file", "block")]
                    found = pa.RecordBatch.from_arrays([*place, *above, part["item"]], names)
                    yield found.filter(part["item"].is_valid())
        if ends and split:
            yield end()

    item = F.lit(None).cast("string").alias("item") if ends else "item"
    return marked.select("file", "block", "s", "c", item).mapInArrow(run, "file string, block long, s string, c string, item string")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """(results, clip_id, label, score, t_start, t_end) of a submission written here, split over tasks by its lines."""
    from spanlake.sources.readers import read_lines

    value = F.col("value")
    is_item = value.startswith('{"label"')
    # the head and a line that closes one section name the section that follows
    section = F.when(~is_item & value.rlike(r'^(\{|\}, )".*": \{$'), F.regexp_extract("value", r'"(\w+)": \{$', 1))
    clip = F.when(~is_item & value.rlike(r'^".*": \[$'), F.from_json(F.concat(F.lit("["), F.regexp_extract("value", r'^(.*): \[$', 1), F.lit("]")), "array<string>")[0])
    marked = read_lines(spark, path).select("file", "block", section.alias("s"), clip.alias("c"), F.when(is_item, F.rtrim(value, F.lit(","))).alias("item"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = filled(marked, True).select("file", "block", *[F.last(x, ignorenulls=True).over(earlier).alias(f"{x}_before") for x in ("s", "c")], F.lit(True).alias("known"))
    rows = filled(marked, False).join(F.broadcast(carry), ["file", "block"], "left")

    def above(x: str):
        # the two reads must cut the file alike
        return F.coalesce(x, F.when(F.col("known"), F.col(f"{x}_before")).otherwise(F.raise_error(F.lit("the file was split in another way while it was read"))))

    item = F.from_json("item", "struct<label: string, score: double, segment: array<double>>")
    found = rows.select(above("s").alias("results"), above("c").alias("clip_id"), item.alias("x"))
    return found.select("results", "clip_id", "x.label", "x.score", F.col("x.segment")[0].alias("t_start"), F.col("x.segment")[1].alias("t_end"))
