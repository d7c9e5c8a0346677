"""Exact dedup with Patricia-trie owners.

Every task first puts its own texts into a trie and hands on one row per distinct text, so a text that holds a
third of all rows arrives as one row per task. Those rows are partitioned by length and content hash; each
partition inserts the full byte strings into a trie whose terminal nodes keep the smallest identifier. A trie
that outgrows its budget gives up its heaviest subtree: the local one hands it on early, the owners' one writes
it to scratch disk and works it off afterwards.

Defined cases: a null text counts as empty; equal texts are those equal after each run of ASCII white space has
become one space; among rows with the same smallest identifier (or only null ones, which sort last) one row
stays; an empty table gives an empty result; any other columns are left alone.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.storage import numbered, settle, spare
from rollcall.llm.streams import tidy
from rollcall.llm.trie import Patricia

WHITE = r"[\x20\x09-\x0D]+"
# Bytes of text and nodes a task's trie may hold before it gives up a subtree.
TRIE_BYTES = 32 << 20

LOCAL = "row long, id long, sha string, length long, hash long, rep long, text binary, n long, first_id long, first_row long"
OWNER = "rep long, keep_id long, keep_row long, group_size long"


def _rank(id_, row):
    return (id_ is None, 0 if id_ is None else id_, row)


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def local_owners(budget: int):
    """Per task: each row with the number of the first row of its text, and each distinct text once."""

    def owners(entries) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, (rep, sha, hash_, n, (no_id, id_, row)) in entries:
            rows.append((None, None, sha, len(text), hash_, rep, text, n, None if no_id else id_, row))
            size += len(text)
            if size > 8 << 20:
                yield _batch(LOCAL, list(zip(*rows, strict=True)))
                rows, size = [], 0
        if rows:
            yield _batch(LOCAL, list(zip(*rows, strict=True)))

    def run(batches):
        trie = Patricia()
        for batch in batches:
            rows, ids, shas, hashes = (batch.column(k).to_pylist() for k in ("row", "id", "sha", "hash"))
            reps = []
            for row, id_, sha, hash_, text in zip(rows, ids, shas, hashes, batch.column("text"), strict=True):
                node = trie.at(text.as_buffer().to_pybytes())
                rank = _rank(id_, row)
                if node.value is None:
                    node.value = [row, sha, hash_, 1, rank]
                else:
                    node.value[3] += 1
                    node.value[4] = min(node.value[4], rank)
                reps.append(node.value[0])
                if trie.size > budget:
                    yield from owners(trie.detach_largest()[1])
            void = [None] * len(rows)
            yield _batch(LOCAL, [rows, ids, shas, void, void, reps, void, void, void, void])
        yield from owners(trie.entries())

    return run


def merge_owners(budget: int):
    """Per length-and-hash partition: the smallest row and the size of each text's group, for every local owner."""

    def absorb(node, value):
        if node.value is None:
            node.value = value
        else:
            node.value[0] = min(node.value[0], value[0])
            node.value[1] += value[1]
            node.value[2].extend(value[2])

    def work(entries) -> Iterator[tuple]:
        trie, spilled = Patricia(), {}
        for key, value in entries:
            file = next((f for p, f in spilled.items() if key.startswith(p)), None)
            if file:
                pickle.dump((key, value), file)
                continue
            absorb(trie.at(key), value)
            if trie.size > budget:
                path, out = trie.detach_largest()
                if out:
                    file = spilled[path] = tempfile.TemporaryFile()
                    for entry in out:
                        pickle.dump(entry, file)
        for _, (rank, n, reps) in trie.entries():
            for rep in reps:
                yield rep, None if rank[0] else rank[1], rank[2], n
        del trie
        for file in spilled.values():
            file.seek(0)
            yield from work(_loaded(file))
            file.close()

    def rows(batches):
        for batch in batches:
            data = batch.to_pydict()
            for text, rep, n, id_, row in zip(*(data[k] for k in ("text", "rep", "n", "first_id", "first_row")), strict=True):
                yield text, [_rank(id_, row), n, [rep]]

    def run(batches):
        out = []
        for found in work(rows(batches)):
            out.append(found)
            if len(out) >= 50_000:
                yield _batch(OWNER, list(zip(*out, strict=True)))
                out = []
        if out:
            yield _batch(OWNER, list(zip(*out, strict=True)))

    return run


def _loaded(file):
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (which carries ``row_col``): id, keep_id, group_size, kept, text_sha256, row."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    texts = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("id"), norm.alias("text")).select(
        "row", "id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text")
    )
    local = settle(texts.mapInArrow(tidy(local_owners(budget)), LOCAL))
    owners = local.where("text is not null").select("length", "hash", "text", "rep", "n", "first_id", "first_row")
    groups = owners.repartition("length", "hash").mapInArrow(tidy(merge_owners(budget)), OWNER)
    members = local.where("row is not null").select("row", "id", "sha", "rep")
    return members.join(groups, "rep").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("row").alias(row_col),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its later copies, columns as they are. ``docs`` should be a stored table."""
    row = spare(docs.columns, "_row")
    rows = numbered(docs, row)
    found = exact_groups(rows.select(F.col(row).alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    dropped = found.where("not kept").select(F.col("_row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)
