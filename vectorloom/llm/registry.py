"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, chat_format, line_dedup, mil_quality, mixing, ngram_join, quality_rules, tiff_media, url_filter, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_tiff_media": tiff_media.op5_tiff_media,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_warc": warc.op8_warc,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_mil_quality": mil_quality.op10_mil_quality,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op3_ngram_join": ngram_join.OP3_SQL,
        "op7_quality_rules": quality_rules.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
    }
