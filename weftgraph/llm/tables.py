"""Reading the input tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.sources.tables import dropped, shared_folder, table, written

__all__ = ["WORD", "dropped", "held_out", "shared_folder", "table", "written"]

#: One word of a text: a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
