"""Fixed texts.

These are output values: users match on them in reject tables and in column
names, so they are kept verbatim and together. Placeholders are filled by
Spark ``format_string``-like concatenation, never per row in Python.
"""

# --- fixed values: reject reasons, written around one value -------------------
INT_FROM_FLOAT = ("無法將 ", " 轉為整數（非整數或溢位）")
INT_FROM_TEXT = ("無法將「", "」解析為整數")
FLOAT_FROM_TEXT = ("無法將「", "」解析為浮點數")
BOOL_FROM_INT = ("無法將 ", " 轉為布林（僅接受 0/1）")
BOOL_FROM_TEXT = ("無法將「", "」解析為布林")
DATETIME_FROM_TEXT = ("無法將「", "」解析為日期時間")
DATE_FROM_TEXT = ("無法將「", "」解析為日期")
UNSUPPORTED = "不支援 Some({source}) → {target} 的轉換"
NULL_NOT_ALLOWED = "欄位為空，但 NULL 政策為不允許"
UNFIT = ("「", "」超出 {type} 可儲存的範圍")
LOOKUP_MISS = "查表 [{alias}] 查無對應："

# --- fixed values: job outcomes ---------------------------------------------
ABORT_ALL_OR_NOTHING = "轉換錯誤超出政策容許，全有全無模式未寫入任何資料"
ABORT_ON_FIRST = "首錯即停：偵測到轉換錯誤"
ABORT_ON_RATE = "錯誤率 {rate:.1f}% 超過上限 {limit}%"

# --- fixed values: name given to a column that has no usable header ----------
UNNAMED_COLUMN = "欄位{n}"
