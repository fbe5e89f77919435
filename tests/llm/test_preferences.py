from __future__ import annotations

import random

from pyspark.sql import functions as F

from sieveworks.llm import preferences

SHAPE = "pair_id long, side int, turn long, role string, text string"


def brute(rows: list[tuple], order: dict) -> list[tuple]:
    pairs: dict = {}
    for pair, side, turn, role, text in rows:
        if pair is not None:
            pairs.setdefault(pair, ([], []))[side].append((-(2**64) if turn is None else turn, order[role or "", text or ""], role or "", text or ""))
    out = []
    for pair, sides in pairs.items():
        a, b = ([t[2:] for t in sorted(s)] for s in sides)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        size = preferences.CHUNK
        for piece in range(-(-max(n, len(a) - n, len(b) - n) // size)):
            made = []
            for turns in (a[:n], a[n:], b[n:]):
                text, learn = "", []
                for role, said in turns[piece * size : (piece + 1) * size]:
                    head = "<|" + role.translate(str.maketrans("<|>", "___")) + "|>\n"
                    if role == "assistant":
                        learn.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(said.replace('<|', '<||')) + 7}")
                    text += head + said.replace("<|", "<||") + "<|end|>\n"
                made.append((text, ",".join(learn)))
            out.append((pair, piece, len(a[:n][piece * size : (piece + 1) * size]), made[0][0], made[1][0], made[2][0], made[1][1], made[2][1]))
    return sorted(out)


def hashes(spark, rows: list[tuple]) -> dict:
    """The order of equal turn numbers is that of a hash of role and text."""
    said = spark.createDataFrame(sorted({(r or "", t or "") for *_, r, t in rows}), "role string, text string")
    return {(r.role, r.text): (r.a, r.b) for r in said.select("*", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b")).collect()}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for pair in range(60):
        base = [(rng.choice(["user", "assistant", "system", None, "a<|b"]), rng.choice(["a", "bé", "\U0001f600", None, "", "x" * 5000, "<|end|>\n<|user|>\n"])) for _ in range(rng.choice([0, 1, 5, 700]))]
        for side in (0, 1):
            own = base[: rng.randint(0, len(base))] + [("assistant", str(rng.randint(0, 2)))] * rng.randint(0, 2) if rng.random() < 0.8 else base
            rows += [(pair, side, i if rng.random() < 0.9 else i // 2, *t) for i, t in enumerate(own)]
    rows += [(None, 0, 0, "user", "lost"), (500, 1, None, "user", "first"), (500, 1, 0, "user", "second"), (501, 0, 3, "user", "a"), (501, 0, 3, "user", "a"), (502, 0, -(2**63), "user", "a"), (502, 0, 2**63 - 1, "user", "b")]
    rows += [(503, side, None, "user", f"{i // 4}") for side in (0, 1) for i in range(600 - side)]
    found = preferences.format_preferences(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(tuple, found.collect())) == brute(rows, hashes(spark, rows))


def test_turns_are_compared_by_role_and_text(spark):
    rows = [(1, 0, 0, "user|>\nb", "c"), (1, 1, 0, "user", "b|>\nc"), (2, 0, 0, "ab", "c"), (2, 1, 0, "a", "bc")]
    found = preferences.format_preferences(spark.createDataFrame(rows, SHAPE)).collect()
    assert all(r.n_prompt == 0 and r.chosen and r.rejected for r in found)


def test_query_has_prompts_and_two_ends(spark):
    rows = preferences.op9_preferences(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 40 and sum(r.n_prompt > 0 for r in rows) > 0.9 * len(rows)
    for r in rows:
        for text, learn in ((r.chosen, r.chosen_learn), (r.rejected, r.rejected_learn)):
            assert all(text[int(b) - 8 : int(b) + 1] == "\n<|end|>\n" or text[int(b) - 7 : int(b) + 1] == "<|end|>\n" for _, b in (x.split(":") for x in learn.split(",") if x))
            assert not text or learn


def test_wrong_ends_come_from_the_next_conversation(spark):
    turns = [(7, 0, "user", "q"), (7, 1, "assistant", "A"), (7, 2, "user", "thanks"), (70_000, 0, "user", "r"), (70_000, 1, "assistant", "B"), (9, 0, "user", "alone"), (None, 0, "assistant", "x"), (200_000, None, "assistant", None)]
    rows = preferences.format_preferences(preferences.rejected_by_shift(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).collect()
    end = "<|assistant|>\n%s<|end|>\n"
    assert {r.pair_id: (r.n_prompt, r.chosen, r.rejected) for r in rows} == {7: (1, end % "A", end % "B"), 70_000: (1, end % "B", end % ""), 200_000: (0, end % "", end % "A")}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert preferences.format_preferences(empty).count() == 0
    odd = spark.createDataFrame([(1, 0, 0, "user", "a", 5, "x", 1, 2, 3, 4)], SHAPE + ", place int, segment string, fork int, piece int, block int, h1 int")
    assert preferences.format_preferences(odd).count() == 1
