"""A small table of documents with nulls, empty, long and repeated texts, and columns of clashing names."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 70)
    rows = [(None, prose(rng, 80)), (1000, None), (1001, ""), (1002, " \t\n "), (1003, "x" * 3000), (1004, prose(rng, 6000)), (1005, "É <|im_end|> ünï <|endoftext|> the")]
    base = prose(rng, 200)
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            text = prose(rng, rng.randrange(1, 60)) + " " + shared + "\n" + prose(rng, rng.randrange(1, 60))
        elif kind == 1:
            text = base
        elif kind == 2:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = "\n".join(["the same line of words again"] * rng.randrange(1, 40))
        else:
            text = prose(rng, rng.randrange(1, 300))
        rows.append((k, text))
    rows += [rows[10], rows[10], (12, "other text of an id that repeats")]
    return [(k, t, rng.choice(["en", "fr", None, "xx"]), "s", rng.randrange(9), 0, "h", 0) for k, t in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, text_hash string, token int"
