"""Role repair: against all repairs of short conversations, and over segment ends."""

import itertools

from corpusbench.llm import chat

ROLES = ("system", "user", "assistant", "?")


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest)) and roles[-1:] == ["assistant"]


def cheapest(roles, spare=4):
    """Least cost over every way to relabel, merge and insert."""
    best = None
    for new in itertools.product(ROLES[:3], repeat=len(roles)):
        for merge in itertools.product((False, True), repeat=len(roles)):
            if merge[:1] == (True,) or any(m and new[k] != new[k - 1] for k, m in enumerate(merge)):
                continue
            cost = sum(chat.MERGE for m in merge if m) + sum(0 if a == b else chat.RELABEL if a in ROLES[:3] else chat.UNKNOWN for a, b in zip(roles, new, strict=True))
            shape = [r for r, m in zip(new, merge, strict=True) if not m]
            # fewest insertions that make the shape legal
            frontier = {(): 0}
            for r in [*shape, None]:
                reach = {}
                for k in range(spare):
                    for extra in itertools.product(ROLES[:3], repeat=k):
                        for done, n in frontier.items():
                            out = (*done, *extra, *([r] if r else []))
                            state = out[-1:] if out else ()
                            if all(b in chat.NEXT[a] for a, b in itertools.pairwise(("" if not done else done[-1], *extra, *([r] if r else [])))):
                                reach[state] = min(reach.get(state, 99), n + k)
                frontier = reach
            n = frontier.get(("assistant",))
            if n is not None and (best is None or cost + n * chat.INSERT < best):
                best = cost + n * chat.INSERT
    return best


def repaired(roles, cuts=()):
    bounds = [0, *cuts, len(roles)]
    parts = [roles[a:b] for a, b in itertools.pairwise(bounds)]
    out, before, states = [], 0, chat.ends([chat.matrix(p) for p in parts])
    for k, (part, (a, b)) in enumerate(zip(parts, states, strict=True)):
        rows = [(i, r, "t") for i, r in enumerate(part)]
        out += list(chat.render(rows, chat.repair(part, a, b), k == 0, k == len(parts) - 1, before))
        before += len(part)
    return out


def test_least_cost_and_legal():
    for n in (1, 2, 3):
        for roles in itertools.product(ROLES, repeat=n):
            rows = repaired(list(roles))
            assert sum(r[5] for r in rows) == cheapest(list(roles)), roles
            assert legal([r[3] for r in rows if r[4] not in ("merge", "close")]), roles


def test_segments_do_not_matter():
    for roles in itertools.product(ROLES, repeat=5):
        whole = repaired(list(roles))
        for cuts in ((1,), (3,), (1, 2, 4)):
            parts = repaired(list(roles), cuts)
            assert sum(r[5] for r in parts) == sum(r[5] for r in whole)
            assert [r[0] for r in parts] == sorted({r[0] for r in parts})


def conversations(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "user", None, 1), (1, 2, "assistant", "c <|im_end|>", 1), (2, 5, None, "x", 1), (2, 5, None, "x", 1), (3, 0, "assistant", "z", 1),
            (None, None, "user", "n", 1), *[(7, k, ("user", "assistant")[k % 2] if k % 5 else "tool", "t", 1) for k in range(60)]]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long")


def test_table(spark):
    turns = conversations(spark)
    got = chat.repair_conversations(turns).collect()
    assert sum(r["action"] in ("keep", "relabel", "merge") for r in got) == turns.count()
    by = {}
    for r in sorted(got, key=lambda r: r["place"]):
        by.setdefault(r["conv_id"], []).append(r)
    assert "".join(r["rendered"] for r in by[1]) == "<|im_start|>user\na\n<|im_end|>\n<|im_start|>assistant\nc <| im_end|><|im_end|>\n"
    for rows in by.values():
        assert legal([r["role"] for r in rows if r["action"] not in ("merge", "close")])
        assert len({r["place"] for r in rows}) == len(rows)
        text = "".join(r["rendered"] for r in rows)
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) and text.endswith(chat.CLOSE + "\n")
    costs = {r["conv_id"]: r["cost"] for r in chat.conversation_costs(chat.repair_conversations(turns)).collect()}
    many = {r["conv_id"]: r["cost"] for r in chat.conversation_costs(chat.repair_conversations(turns, parts=9)).collect()}
    assert costs == many and costs[3] == chat.INSERT
    assert chat.repair_conversations(turns.limit(0)).count() == 0
