"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, gif, langid, linededup, packing, pii, sharding, simhash, sstable, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_gif": gif.op4_gif,
    "op5_shuffle": sharding.op5_shuffle,
    "op6_sstable": sstable.op6_sstable,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_langid": langid.op9_langid,
    "op10_best_fit": packing.op10_best_fit,
}
ORACLE_SQL = {"op1_warc": warc.OP1_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op3_line_dedup": linededup.OP3_SQL}
