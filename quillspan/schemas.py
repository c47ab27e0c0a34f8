"""Types of the evaluation records, items and corpus rows. A missing field reads as null."""

from __future__ import annotations

USAGE = "struct<prompt_tokens:long,completion_tokens:long>"
TIMINGS = "struct<predicted_per_second:double,draft_n:long,draft_n_accepted:long>"
RECORD = (
    f"id long, lang string, gold string, content string, reasoning_content string, finish_reason string, usage {USAGE}, timings {TIMINGS}, wall double, tag string, "
    "qid string, category string, n_options long, thinking string, repeat long, seed long, fixed string, system string, reasoning_tokens long, answer_tokens long"
)
MESSAGES = "array<struct<role:string,content:string>>"
SAMPLE = f"row_index long, messages {MESSAGES}, source string, dataset_name string, ds_uid string"
#: A fix may hold any JSON value.
FIX = "bench string, id long, field string, original variant, fixed variant"
MANIFEST = "model string, bench string, setting string, tag string, raw string, ids string, expected_n long"
FERTILITY = "source string, lang string, tokens long, chars long"
LENGTHS = "shard string, row_group int, row int, source string, dataset_name string, n_tokens long"
TOKEN_SPLIT = "id long, lang string, reasoning_tokens long, answer_tokens long"
ITEM_NUMBER = "id long, question string, answer_number double"
ITEM_CHOICE = "id long, qid string, passage string, question string, options array<string>, gold string"
KEY = ["tag", "bench", "id", "lang", "repeat"]
