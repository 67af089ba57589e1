"""Sections of documents: cutting, typing, and relating them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_SIZE, RELATION_CONFIDENCE, RELATION_TERMS, RELATION_TYPE
from ..functions.splitter import recursive_chunks
from ..functions.text import fixed_chunks, has_assignment, heading, section_type, term_mask

# Sections of one document meet in blocks of 2 ** 9, so that one join key never
# stands for more than the square of that.
RELATION_BLOCK_BITS = 9


def chunks(text: Column, method: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunk array of a text, by separators (``recursive``) or by position (``fixed``)."""
    if method not in ("recursive", "fixed"):
        raise ValueError(f"unknown chunking method: {method}")
    cut = recursive_chunks if method == "recursive" else fixed_chunks
    return cut(text, size, overlap)


def chunk_documents(docs: DataFrame, method: str = "recursive", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: ``doc_id, id, content``."""
    # Exploding the expression itself: over a column, Spark would infer a filter on
    # the array's size and cut every text again to evaluate it.
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"), method, size, overlap)).alias("id", "content"))


def identify_sections(docs: DataFrame, method: str = "recursive", size: int = CHUNK_SIZE,
                      overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per section: ``doc_id, id, type, heading, content, length``."""
    content = F.col("content")
    return chunk_documents(docs, method, size, overlap).select(
        "doc_id", "id",
        section_type(content).alias("type"),
        heading(content).alias("heading"),
        "content",
        F.length(content).alias("length"),
    )


def config_sections(sections: DataFrame) -> DataFrame:
    """Sections typed ``configuration`` or holding an assignment; ``id`` keeps their order."""
    return sections.where((F.col("type") == "configuration") | has_assignment(F.col("content")))


def section_terms(sections: DataFrame, terms: Sequence[str] = RELATION_TERMS) -> DataFrame:
    """The relationships in linear size: one row per section and term it contains.

    Two different sections of a document are related exactly when they share a
    term here.
    """
    held = [F.when(F.contains(F.lower("content"), F.lit(t)), F.lit(t)) for t in terms]
    return sections.select("doc_id", "id", F.explode(F.array_compact(F.array(*held))).alias("term"))


def relate_sections(sections: DataFrame, terms: Sequence[str] = RELATION_TERMS,
                    block_bits: int = RELATION_BLOCK_BITS) -> DataFrame:
    """Ordered pairs of sections of one document that share a term, both directions.

    An equi-join on ``(doc_id, term)``.  A pair sharing several terms is kept
    at its first one only, so no ``distinct`` is needed.  Documents with more
    sections than a block join block by block: the key then also carries the
    two block numbers, which spreads a huge document over many tasks.  Only
    ids and a bit mask are shuffled, never the contents.
    """
    mask, block = term_mask(F.col("content"), terms), F.shiftright("id", block_bits)
    masked = (
        sections.select("doc_id", "id", block.alias("block"), mask.alias("mask"))
        # Stated here because the join would add it for two of the three uses only.
        .where((F.col("mask") != 0) & F.col("doc_id").isNotNull() & F.col("id").isNotNull() & F.col("block").isNotNull())
        # The three uses below share this exchange; without it each would cut
        # and search the texts again.  Both columns: a hot document spreads.
        .repartition(F.col("doc_id"), F.col("id"))
    )
    large = (
        masked.groupBy("doc_id")
        # Naming the mask keeps this use of the exchange identical to the others.
        .agg(F.max(F.when(F.col("mask") != 0, F.col("block"))).alias("last_block"))
        .where(F.col("last_block") > 0)
    )
    blocked = masked.join(large, "doc_id", "left").select(
        "doc_id", "id", "mask", "block",
        F.sequence(F.lit(0), F.coalesce("last_block", F.lit(0))).alias("blocks"),
        # Outer, because the inner form would push a filter below the shared exchange.
        F.explode_outer(_set_bits(F.col("mask"), len(terms))).alias("term"),
    )
    source = blocked.select(
        "doc_id", "term", F.col("id").alias("source"), F.col("mask").alias("source_mask"),
        F.col("block").alias("source_block"), F.explode("blocks").alias("target_block"),
    )
    target = blocked.select(
        "doc_id", "term", F.col("id").alias("target"), F.col("mask").alias("target_mask"),
        F.explode("blocks").alias("source_block"), F.col("block").alias("target_block"),
    )
    shared = F.col("source_mask").bitwiseAND(F.col("target_mask"))
    first_shared = shared.bitwiseAND(-shared) == F.col("term")
    pairs = source.join(target, ["doc_id", "term", "source_block", "target_block"])
    return pairs.where((F.col("source") != F.col("target")) & first_shared).select(
        "doc_id", "source", "target",
        F.lit(RELATION_TYPE).alias("type"),
        F.lit(RELATION_CONFIDENCE).alias("confidence"),
    )


def _set_bits(mask: Column, count: int) -> Column:
    """The set bits of a mask, each as its own number, in an array."""
    bits = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(1 << i)) for i in range(count)]
    return F.array_compact(F.array(*bits))
