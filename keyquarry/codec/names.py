"""Names and numbers of the snapshot format."""

from __future__ import annotations

# Object type codes, in order of code.
STRING, LIST, SET, ZSET, HASH, ZSET_2, MODULE_PRE_GA, MODULE_2 = range(8)
HASH_ZIPMAP, LIST_ZIPLIST, SET_INTSET, ZSET_ZIPLIST, HASH_ZIPLIST, LIST_QUICKLIST, STREAM_1, HASH_LISTPACK, ZSET_LISTPACK, LIST_QUICKLIST_2, STREAM_2, SET_LISTPACK, STREAM_3, HASH_2 = range(9, 23)

#: Logical type and encoding name of each code.
TYPES = {
    0: ("string", "string"), 1: ("list", "linkedlist"), 2: ("set", "hashtable"), 3: ("zset", "skiplist"), 4: ("hash", "hashtable"), 5: ("zset", "skiplist"),
    6: ("module", "module"), 7: ("module", "module"), 9: ("hash", "zipmap"), 10: ("list", "ziplist"), 11: ("set", "intset"), 12: ("zset", "ziplist"),
    13: ("hash", "ziplist"), 14: ("list", "quicklist"), 15: ("stream", "stream"), 16: ("hash", "listpack"), 17: ("zset", "listpack"), 18: ("list", "quicklist2"),
    19: ("stream", "stream2"), 20: ("set", "listpack"), 21: ("stream", "stream3"), 22: ("hash", "hashtable"),
}

#: Codes whose value is counted element by element, so that long values come in chunks.
PLAIN = frozenset({LIST, SET, ZSET, HASH, ZSET_2, HASH_2})

#: Types that no value decides on: of the others a sketch may be a string, and positions may be a sorted set.
SHALLOW = frozenset({"list", "set", "hash", "module", "stream"})

# Opcodes, from the highest down.
OP_EOF, OP_SELECTDB, OP_EXPIRETIME, OP_EXPIRETIME_MS, OP_RESIZEDB, OP_AUX, OP_FREQ, OP_IDLE, OP_MODULE_AUX, OP_FUNCTION_PRE_GA, OP_FUNCTION2, OP_SLOT_INFO, OP_SLOT_IMPORT = range(255, 242, -1)

# What module values are.
MODULE_EOF, MODULE_SINT, MODULE_UINT, MODULE_FLOAT, MODULE_DOUBLE, MODULE_STRING = range(6)
MODULE_OPCODES = {MODULE_SINT: "sint", MODULE_UINT: "uint", MODULE_FLOAT: "float", MODULE_DOUBLE: "double", MODULE_STRING: "string"}
MODULE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"

# Limits against damaged counts.
MAX_ALLOCATION = 512 << 20
MAX_INTSET = 10_000_000
MAX_STREAM_ENTRIES = 5_000_000
MAX_MODULE_VALUES = 5_000_000
MAX_MODULE_BYTES = 256 << 20
MAX_LZF_RATIO = 1024
DEFAULT_CHUNK = 50_000
