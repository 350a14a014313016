"""Fixed values that must equal the reference's for results to match.

These are stated plainly and together, in their natural order.
"""

# --- fixed values: control tokens -------------------------------------------
CONVO_START = "<_soc_>"
CONVO_END = "<_eoc_>"
USR_START = "USR:"
USR_END = "<_cus_end_>"
SYS_START = "SYS:"
SYS_END = "<_rep_end_>"
BOT_START = "BOT:"
BOT_END = "<_bot_end_>"
PAD_TOKEN = "<pad>"
END_TOKEN = "<|endoftext|>"
REDACTED = "<REDACTED>"

# stop tokens of a generated conversation (BOT: is deliberately not one)
CONVO_STOP_TOKENS = [USR_START, SYS_START, PAD_TOKEN, CONVO_START, CONVO_END, END_TOKEN]

# characters stripped from both ends of an n-gram before a dictionary lookup
PUNCTUATION_CHARS = ".,?!"

# role of a dialogue turn -> speaker token
ROLE_TOKENS = {"customer": USR_START, "agent": SYS_START, "bot": BOT_START}

# task -> domain -> domain token
TASK_DOMAINS = {
    "dogo": ["AIRLINE", "FASTFOOD", "FINANCE", "INSURANCE", "MEDIA", "SOFTWARE"],
    "dogo60": ["AIRLINE", "FASTFOOD", "FINANCE", "INSURANCE", "MEDIA", "SOFTWARE"],
    "airline_media_ins": ["AIRLINE", "MEDIA", "INSURANCE"],
    "airline_media_ins60": ["AIRLINE", "MEDIA", "INSURANCE"],
}
# --- end of fixed values ------------------------------------------------------


def domain_token(domain: str) -> str:
    return f"<{domain}>"


def task_domain_tokens(task: str) -> dict[str, str]:
    if task not in TASK_DOMAINS:
        raise ValueError(f"unknown task {task!r}; known: {sorted(TASK_DOMAINS)}")
    return {d: domain_token(d) for d in TASK_DOMAINS[task]}


def stop_tokens(task: str) -> list[str]:
    """Control stop tokens followed by the task's domain tokens."""
    return CONVO_STOP_TOKENS + list(task_domain_tokens(task).values())


# Whitespace as Python's str.split() sees it, written as one regex character
# class that both Java regex (Spark) and RE2 (DuckDB) accept.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
