"""Schemas of the engine's records, as DDL."""

from __future__ import annotations

EVENT = "received_at timestamp, source string, payload string"
FRAME = "file string, offset long, ts_ns long, data binary, crc long, status string"
KV_RECORD = "op string, raft_index long, key string, value string"
LOG_RECORD = "seq long, rec_type int, index long, term long, entry_type int, data binary, from_index long, status string"
COMMAND = "op string, key string, value string"
SNAPSHOT = "index long, term long, kv map<string,string>, phase int, voters array<string>, new_voters array<string>, crc long, status string"
META = "term long, voted_for string, status string"

#: Entry types of a replicated log, and its two kinds of record.
COMMAND_ENTRY, CONFIG_ENTRY = 0, 1
ENTRY_RECORD, TRUNCATE_RECORD = 1, 2
#: The key under which a store keeps how far it has applied; users can't write it.
APPLIED_KEY = "__raft_last_applied__"
