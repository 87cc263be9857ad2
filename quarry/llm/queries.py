"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, clustering, decontaminate, hardneg, langid, mixing, notices, quality, simhash, sketch, substrings, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_langid": langid.op3_langid,
    "op4_sketch": sketch.op4_sketch,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat": chat.op6_chat,
    "op7_notices": notices.op7_notices,
    "op8_simhash": simhash.op8_simhash,
    "op9_urlfilter": urlfilter.op9_urlfilter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hardneg": hardneg.op11_hardneg,
    "op12_clustering": clustering.op12_clustering,
    "op13_substrings": substrings.op13_substrings,
}

ORACLE_SQL = {"op1_warc": warc.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op6_chat": chat.ORACLE_SQL, "op9_urlfilter": urlfilter.ORACLE_SQL, "op10_decontaminate": decontaminate.ORACLE_SQL, "op11_hardneg": hardneg.ORACLE_SQL, "op12_clustering": clustering.ORACLE_SQL, "op13_substrings": substrings.ORACLE_SQL}
