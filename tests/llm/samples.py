"""Texts and rows that the tests share."""

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew strange potions near quiet rivers under pale winter moons".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ing", "ed", "s", str(r.randrange(99))]) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, sha binary, d string, key string, n long, item_id long, held_out string, path string"


def edge_rows() -> list[tuple]:
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)), (7, "é😀 ﬁ 日本語 x\x00y"), (8, prose(8, 30000)), (9, "z" * 200_000), (None, prose(10, 40)), (None, None), (11, "<|endoftext|> </s> [INST]"), (12, prose(5, 59) + " changed")]
    return [(i, t, None, None if i == 4 else "s", None, 7, 0.5, b"x", "clash", "clash", 3, 9, "no", "p") for i, t in texts]
