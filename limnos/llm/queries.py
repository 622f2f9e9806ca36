"""Registered queries of this subpackage and their DuckDB text."""

from __future__ import annotations

from limnos.llm import align, chat, decontaminate, licenses, packing, quality, secrets, simhash, substrings, token_counts, token_store, trie, warc
from limnos.llm.common import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_token_counts")
def _(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op3_token_store")
def _(spark, sf_dir):
    return token_store.token_store(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def _(spark, sf_dir):
    return substrings.substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


@query("op8_simhash_near_dedup")
def _(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def _(spark, sf_dir):
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_host_quality", quality.ORACLE)
def _(spark, sf_dir):
    return quality.host_quality(table(spark, sf_dir, "documents"))


@query("op6_warc_revisits", warc.ORACLE)
def _(spark, sf_dir):
    return warc.warc_revisits(table(spark, sf_dir, "pages"))


@query("op4_license_scan")
def _(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("found")


@query("op9_chat_repair")
def _(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op12_secret_scan")
def _(spark, sf_dir):
    return secrets.digests(secrets.secret_scan(table(spark, sf_dir, "documents")))


@query("op11_alignment")
def _(spark, sf_dir):
    return align.alignment(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", trie.ORACLE)
def _(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
