"""JSON documents that change by operations: written as bases and deltas by a policy, read as of any change.

A definition says what a new document is, how an older version is brought up to date, and
when a change is stored as a whole. The writer keeps, per document, its value and how many
deltas follow its newest base; a change becomes a base when the document is new, when its
stored version is older than the definition's, or when the policy says so. So a read folds
one base and the deltas behind it, as many as the policy allows, whatever the history.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import deltas

REVISIONS = "document_id long, seq long, kind string, version int, content string"


@dataclass(frozen=True)
class Definition:
    """initial() is a document without changes; migrate(value, version) brings a value of an
    older version to this one; checkpoint_when(value, ops, deltas_since_base) says whether
    the change that led to value is stored as a base."""

    version: int
    initial: Callable[[], dict]
    migrate: Callable[[dict, int], dict] | None = None
    checkpoint_when: Callable[[dict, list, int], bool] | None = None

    def upgraded(self, value: dict, version: int) -> dict:
        if version > self.version:
            raise ValueError(f"version {version} is newer than {self.version}")
        if version < self.version and self.migrate is None:
            raise ValueError(f"no way from version {version} to {self.version}")
        return value if version == self.version else self.migrate(value, version)


class Writer(StatefulProcessor):
    """Per document its value, version, last sequence number and deltas since its base."""

    def __init__(self, definition: Definition):
        self.definition = definition

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.doc = handle.getValueState("doc", "value string, version int, seq long, since int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        d, out = self.definition, []
        value, version, last, since = d.initial(), None, None, 0
        if self.doc.exists():
            text, version, last, since = self.doc.get()
            value = json.loads(text)
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if last is not None and row.seq <= last:
                continue  # delivered before
            ops = json.loads(row.ops)
            old = version is not None and version < d.version
            value = deltas.apply(d.upgraded(value, version) if old else copy.deepcopy(value), ops)
            base = version is None or old or bool(d.checkpoint_when and d.checkpoint_when(value, ops, since))
            since = 0 if base else since + 1
            version, last = d.version, int(row.seq)
            out.append((key[0], last, "base" if base else "delta", version, json.dumps(value, sort_keys=True) if base else row.ops))
        if out:
            self.doc.update((json.dumps(value), version, last, since))
            yield pd.DataFrame(out, columns=["document_id", "seq", "kind", "version", "content"])

    def close(self) -> None:
        pass


def revisions(changes: DataFrame, definition: Definition) -> DataFrame:
    """The revisions of a feed of changes (document_id, seq, ops as JSON) in order of seq per
    document; a change whose seq is not newer than the last is taken as delivered before.
    Needs the RocksDB state store provider."""
    return changes.groupBy("document_id").transformWithStateInPandas(Writer(definition), REVISIONS, "append", "none")


def as_of(stored: DataFrame, definition: Definition, at: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(document_id, content) of stored revisions as they were after change `at` (or now),
    brought to the definition's version; documents of ids (document_id) that had no change
    by then are initial ones. Only the newest base and what follows it is folded."""
    rows = stored if at is None else stored.where(F.col("seq") <= at)
    base = rows.where("kind = 'base'").groupBy("document_id").agg(F.max("seq").alias("base"))
    live = rows.join(base, "document_id").where("seq >= base")
    chains = live.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("seq", "version", "content"))).alias("chain"))
    if ids is not None:
        chains = ids.select("document_id").distinct().join(chains, "document_id", "left")

    @F.arrow_udf("string")
    def folded(chain: pa.Array) -> pa.Array:
        out = []
        for rows in chain.to_pylist():
            if rows is None:
                value = definition.initial()
            else:
                value = json.loads(rows[0]["content"])
                for r in rows[1:]:
                    value = deltas.apply(value, json.loads(r["content"]))
                value = definition.upgraded(value, rows[0]["version"])
            out.append(json.dumps(value, sort_keys=True))
        return pa.array(out, pa.string())

    return chains.select("document_id", folded("chain").alias("content"))
