"""Pure-Python expectations written from the operator definitions."""

PUNCT = ".,?!"
REDACTED = "<REDACTED>"


def ngrams(seq, n):
    # sliding windows; n == 0 yields nothing
    if n <= 0:
        return []
    return [tuple(seq[i:i + n]) for i in range(len(seq) - n + 1)]


def word_ngrams(text, lo=1, hi=3):
    toks = text.split()
    return [" ".join(x) for n in range(hi, lo - 1, -1) for x in ngrams(toks, min(n, len(toks)))]


def redact(text, keywords, lo=1, hi=3):
    kw = [k.lower() for k in keywords]
    out = text
    for w in word_ngrams(text, lo, hi):
        if w.lower().strip(PUNCT) in kw:
            out = out.replace(w, " ".join([REDACTED] * len(w.split())))
    return out


ROLE = {"customer": "USR:", "agent": "SYS:", "bot": "BOT:"}


def prompts(turns, domain_token, max_prompts):
    """turns: ordered list of (role, utterance)."""
    out, so_far = [], []
    for i, (role, utt) in enumerate(turns):
        if i >= max_prompts >= 0:
            break
        if i == len(turns) - 1:
            break
        pre = "" if domain_token is None else f"{domain_token} "
        so_far.append(pre + f"{ROLE[role]} {utt.strip()}")
        nxt = pre + ROLE[turns[i + 1][0]]
        out.append("<_soc_> " + " ".join(so_far + [nxt]))
    return out
