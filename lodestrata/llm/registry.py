"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestrata.llm import bitsliced, bpe, chat, jaccard, language, licences, lines, mixing, neighbours, toxicity

QUERIES = {
    "op1_nearest": neighbours.op1_nearest,
    "op2_chat_format": chat.op2_chat_format,
    "op3_pivotal_mix": mixing.op3_pivotal_mix,
    "op4_language": language.op4_language,
    "op5_licences": licences.op5_licences,
    "op6_bit_sliced_top": bitsliced.op6_bit_sliced_top,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
}

#: SQL can express neither what is trained (op4, op8) or approximate (op1), nor draws by hashes in a tree (op3), nor merges of byte pairs (op10).
ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op5_licences": licences.OP5_SQL,
    "op6_bit_sliced_top": bitsliced.OP6_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
}
