"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locus.llm import chains, hilbert, langid, minhash, mixing, packing, repair, repeats, templates, tokens, trie, vafile, warc
from locus.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert": lambda spark, d: hilbert.op1_hilbert(table(spark, d, "documents")),
        "op2_vafile": lambda spark, d: vafile.op2_vafile(table(spark, d, "embeddings")),
        "op3_warc": lambda spark, d: warc.op3_warc(table(spark, d, "pages")),
        "op4_minhash": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
        "op5_kneser_ney": lambda spark, d: langid.op5_kneser_ney(table(spark, d, "documents")),
        "op6_templates": lambda spark, d: templates.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_poisson": lambda spark, d: mixing.op7_poisson(table(spark, d, "documents")),
        "op8_chains": lambda spark, d: chains.op8_chains(table(spark, d, "documents")),
        "op9_packing": lambda spark, d: packing.op9_packing(table(spark, d, "documents")),
        "op10_bwt": lambda spark, d: repeats.op10_bwt(table(spark, d, "documents")),
        "op11_auction": lambda spark, d: repair.op11_auction(table(spark, d, "conversations")),
        "op12_trie": lambda spark, d: trie.op12_trie(table(spark, d, "conversations")),
        "op13_token_counts": lambda spark, d: tokens.op13_token_counts(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_vafile": vafile.OP2_SQL, "op3_warc": warc.OP3_SQL, "op4_minhash": minhash.OP4_SQL, "op6_templates": templates.OP6_SQL, "op7_poisson": mixing.OP7_SQL, "op10_bwt": repeats.OP10_SQL,
        "op11_auction": repair.OP11_SQL, "op12_trie": trie.OP12_SQL,
    }
