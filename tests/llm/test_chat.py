import hashlib
import random

import public_tokenizers

from flowspark.llm import chat

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def conversations():
    rnd = random.Random(4)
    bits = ["ok ", "</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[\\INST]", "<\\\\/s>", "é\n", "\\", "[", "<", "s>", "words of a turn "]
    rows = []
    for c in [*range(40), None]:
        turns = rnd.choice([1, 2, 5, 30]) if c != 3 else 700
        for t in range(turns):
            role = "system" if t == 0 and rnd.random() < 0.5 else ["user", "assistant", "tool [ROLE]", "assistant"][t % 4]
            text = None if rnd.random() < 0.05 else "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 5, 60])))
            rows.append((c, t if rnd.random() < 0.97 else None, role, text))
    rows += [(5, 900, "assistant", "same"), (5, 900, "assistant", "same"), (6, 901, None, "x"), (7, 902, "assistant", "long " * 4000), (8, 0, "user", "tie"), (8, 0, "assistant", "tie")]
    return rows


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, window int, begin string").repartition(4)
    for budget in (chat.Budget(), chat.Budget(tokens=200, history=40, least=30, chunk=16)):
        made = chat.windows(df, RANKS, budget)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
        assert got == brute(rows)
        for w in made.collect():
            assert w.tokens <= budget.tokens or (w.over and w.turns == 1) or budget.tokens == 200  # a long system turn may exceed a small budget
            parts = list(chat.parse(w.text))
            assert len(parts) == w.repeated + w.turns
            spans = {(s.begin, s.end) for s in w.loss}
            own = [(b, e) for r, _, b, e in parts[w.repeated :] if r == "assistant"]
            assert spans == set(own)


def test_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " * 10) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.windows(df, RANKS, chat.Budget(tokens=300, history=80, least=30)).orderBy("window").collect()
    assert len(got) > 3 and all(w.tokens <= 300 for w in got)
    for w in got[1:]:
        parts = list(chat.parse(w.text))
        assert parts[0][:2] == ("system", "be brief") and w.repeated >= 2
    assert chat.windows(df.limit(0), RANKS).count() == 0
    assert chat.read_back(chat.windows(df.limit(0), RANKS)).count() == 0


def test_windows_are_filled(spark):
    """A conversation within the budget is one window; those of a long one are full but for turns that do not fit."""
    rnd = random.Random(3)
    rows = [(1, t, "user" if t % 2 else "assistant", " ".join(rnd.choice(["some", "words", "here"]) for _ in range(rnd.randint(5, 180)))) for t in range(1500)]
    rows += [(2, 0, "system", "be brief")] + [(2, t, "assistant", "word " * 100) for t in range(1, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, RANKS).collect()
    short = [w for w in made if w.conv_id == 2]
    assert len(short) == 1 and short[0].turns == 20 and short[0].repeated == 0 and 1900 < short[0].tokens <= 2048
    long = sorted((w for w in made if w.conv_id == 1), key=lambda w: w.window)[:-1]
    assert all(w.tokens <= 2048 for w in long) and sum(w.tokens for w in long) / len(long) > 0.8 * 2048
    assert sum(w.turns == 1 for w in long) < 0.05 * len(long)


def test_escape_is_reversible():
    rnd = random.Random(1)
    bits = ["<", "s>", "/", "\\", "[", "INST]", "ROLE]", "</s>", "a"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(m in e for m in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))
