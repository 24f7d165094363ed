import random
from itertools import product

from guide_engine.llm import chat

TURN = "conv_id long, turn long, role string, text string, pos long, block string"


def brute(roles):
    """The least (price, turns) over all labellings, by exhaustion."""
    best = None
    for labels in product((1, 2, 3), repeat=len(roles)):
        for merges in product((False, True), repeat=len(roles)):
            at, price, n = 0, 0, 0
            for label, role, merged in zip(labels, roles, merges):
                price += 0 if label == role else chat.RELABEL
                if merged:
                    if at != label:
                        break
                    price += chat.MERGE
                else:
                    if (at, label) not in chat.PATHS:
                        break
                    k = len(chat.PATHS[at, label])
                    price += chat.INSERT * k
                    n += k + 1
                at = label
            else:
                price += chat.INSERT * len(chat.ENDING[at])
                n += len(chat.ENDING[at])
                best = min(best or (9**9, 0), (price, n))
    return best


def together(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["out_turn"], r["piece"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def check(spark, turns, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    frame = spark.createDataFrame([(*t, 5, "x") for t in turns], TURN)
    by = together(chat.op6_query(spark, frame).collect())
    convs = {}
    for c, t, role, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or "")):
        convs.setdefault(c, []).append((role, text))
    assert by.keys() == convs.keys()
    texts = {}
    for c, rows in by.items():
        names, pieces = [], {}
        for r in rows:
            pieces.setdefault(r["out_turn"], []).append(r)
        assert sorted(pieces) == list(range(len(pieces)))
        state = 0
        price = 0
        for k in sorted(pieces):
            role = chat.NAMES.index(pieces[k][0]["role"])
            assert role in chat.LEGAL[state] and len({r["role"] for r in pieces[k]}) == 1
            state = role
            names.append(role)
            n = sum(r["n_merged"] for r in pieces[k])
            price += chat.INSERT if n == 0 else chat.MERGE * (n - 1)
        assert state == 3
        if len(convs[c]) <= 6:
            want = brute([chat.role_code(r) for r, _ in convs[c]])
            flat = [k for k in sorted(pieces) for _ in range(sum(r["n_merged"] for r in pieces[k]))]
            price += sum(chat.RELABEL for k, (role, _) in zip(flat, convs[c]) if chat.NAMES.index(pieces[k][0]["role"]) != chat.role_code(role))
            assert (price, len(pieces)) == want
        whole = "".join(r["rendered"] for r in rows)
        assert whole.count("<|end|>") == len(pieces)
        body = [x for part in whole.split("\n<|end|>\n")[:-1] for x in part.split("\n")[1:]]
        assert [b for b in body if b] == [t for _, t in convs[c] if t]
        texts[c] = whole
    return texts


def test_cheapest_repair_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(5)
    turns = []
    for c in range(25):
        for t in range(rng.randint(1, 6)):
            turns.append((c, t, rng.choice(["system", "user", "assistant", None, "tool"]), rng.choice(["hi", "", None, f"w{c}.{t}"])))
    turns += [(99, t, "user" if t % 3 else "assistant", f"long{t}") for t in range(60)] + [(None, 1, "user", "q"), (None, None, "assistant", "a"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    whole = check(spark, turns, monkeypatch, 2048)
    for block in (7, 1):  # wherever blocks are cut and whatever else is in the table, a conversation is repaired alike
        assert check(spark, turns, monkeypatch, block) == whole
    assert check(spark, [t for t in turns if t[0] in (3, 99)], monkeypatch, 5) == {c: whole[c] for c in (3, 99)}


def test_empty_table(spark):
    assert chat.op6_query(spark, spark.createDataFrame([], TURN)).count() == 0
