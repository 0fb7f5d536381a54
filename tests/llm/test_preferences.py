"""Preference formatting against plain Python."""

import random
from collections import defaultdict
from hashlib import md5

from siren.llm.preferences import RANKED, branched, format_preferences

SCHEMA = "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"


def render(turns):
    parts = []
    for role, text in turns:
        role, text = role or "user", (text or "").replace("<|im_", "< |im_")
        parts += [(f"<|im_start|>{role}\n", False), (f"{text}<|im_end|>", role == "assistant"), ("\n", False)]
    return "".join(t for t, _ in parts), [(len(t), trained) for t, trained in parts]


def expected(chosen, rejected):
    def clean(turns):
        return [(r or "user", t or "") for r, t in turns or []]

    chosen, rejected = clean(chosen), clean(rejected)
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    return k, render(chosen[:k])[0], *render(chosen[k:]), *render(rejected[k:])


def test_format_preferences(spark):
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", None], ["a", "b", "é <|im_end|> x", "", None, "l" * 20_000]
    pairs = [(None, None), ([], [("user", "a")]), ([("user", None)], [(None, "")])]
    for _ in range(60):
        prefix = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 4))]
        pairs.append([prefix + [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 3))] for _ in range(2)])
    rows = [(k, c, r, "clash") for k, (c, r) in enumerate(pairs)] + [(0, *pairs[5], "clash")]
    found = format_preferences(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        masks = [[(m.chars, m.trained) for m in side] for side in (r.chosen_mask, r.rejected_mask)]
        got = (r.prompt_turns, r.prompt, r.chosen, masks[0], r.rejected, masks[1])
        assert got in (expected(*pairs[r.id]), expected(*pairs[5]))
        assert sum(n for n, _ in masks[0]) == len(r.chosen)
    assert format_preferences(spark.createDataFrame([], SCHEMA)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, chosen string"


def expected_pairs(turns):
    talks = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            talks[conv].append((turn, role, text))
    for talk in talks.values():
        talk.sort(key=lambda t: [(x is not None, x if x is not None else 0) for x in t])
    digest = {c: md5(str(c).encode()).hexdigest() for c in talks}
    answers = {c: [k for k, t in enumerate(talk) if t[1] == "assistant"] for c, talk in talks.items()}
    circles = defaultdict(list)
    answered = [c for c in talks if answers[c]]
    for c in answered:
        circles[int(digest[c][:8], 16) % max(len(answered) // RANKED, 1)].append(c)
    out = {c: ([t[1:] for t in talk], [t[1:] for t in talk]) for c, talk in talks.items()}
    for circle in circles.values():
        circle.sort(key=lambda c: (digest[c], c))
        for c, other in zip(circle, circle[1:] + circle[:1], strict=True):
            if other != c:
                at = answers[c][int(digest[c][8:16], 16) % len(answers[c])]
                behind = answers[other][int(digest[other][16:24], 16) % len(answers[other])]
                out[c] = (out[c][0], [t[1:] for t in talks[c][:at] + talks[other][behind:]])
    return out


def found_pairs(rows):
    pairs = branched(rows).collect()
    assert len(pairs) == len({r.conv_id for r in pairs})
    return {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in pairs}


def test_branched_loses_no_conversation(spark):
    turns = [
        (0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 2, "user", "thanks"), (1, 0, "user", "w"), (1, 1, "assistant", None),
        (2, 0, "user", "no answer"), (3, 0, "assistant", "x" * 100_000), (None, 0, "assistant", "?"), (60, None, None, None),
        (60, 1, "assistant", "a"), (60, 1, "assistant", "a"), (7000, 0, "assistant", "b"), (7000, 0, None, "b"), (-5, 3, "assistant", ""),
    ]
    rows = spark.createDataFrame([(*t, "z") for t in turns], TURNS)
    found = found_pairs(rows)
    assert found == expected_pairs(turns) and len(found) == 7
    assert found[2][0] == found[2][1] and sum(a != b for a, b in found.values()) >= 4
    assert branched(rows.limit(0)).count() == 0
    alone = rows.where("conv_id = 0")
    assert all(a == b for a, b in found_pairs(alone).values())


def test_branches_part_at_any_answer(spark):
    rng = random.Random(2)
    turns = []
    for conv in rng.sample(range(10**12), 900):  # ids are sparse
        for k in range(rng.randint(1, 8)):
            turns.append((conv, k, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", f"word {conv}"])))
    rows = spark.createDataFrame([(*t, None) for t in turns], TURNS)
    found = found_pairs(rows)
    assert found == expected_pairs(turns)
    lengths = {(r.prompt_turns, len(found[r.conv_id][0])) for r in format_preferences(branched(rows)).collect()}
    assert len({n - k for k, n in lengths}) > 5 and len({k for k, _ in lengths}) > 5
