"""Checked translation, against a plain loop over the rows."""

import json
import random

import pytest

from confab.operators import translation

KIND = "recording_id long, seg_id int, batch_id int, text string, text_pl string"


def score(prompts):
    """Marks are written in the translations: ``...|m``; some replies are broken."""
    out = []
    for p in prompts:
        lines = [line for line in p.split("\n") if line.startswith("   [pl] ")]
        marks = [int(line[-1]) for line in lines]
        kind = sum(map(ord, lines[0])) % 5
        out.append({0: "broken {", 1: json.dumps({"scores": [*marks, 1, 1]}), 2: "[1]"}.get(kind, json.dumps({"scores": marks, "avg": sum(marks) / len(marks)})))
    return out


def retry(prompts):
    """All that was shown, in capitals, so that every change of a neighbour is seen; sometimes blank or the original."""
    out = []
    for p in prompts:
        own = p.split("TRANSLATE: ")[1].split("\n")[0]
        kind = sum(map(ord, p)) % 7
        out.append({0: None, 1: "  ", 2: " " + own.upper() + " "}.get(kind, " <" + p.replace("\n", "~")[-60:] + "|4 "))
    return out


def looped(rows, language="de"):
    """One recording's rows (seg_id, batch_id, text, text_pl), in order."""
    rows, averages, low = [dict(r) for r in rows], [], []
    for b in sorted({r["batch_id"] for r in rows}):
        own = [i for i, r in enumerate(rows) if r["batch_id"] == b][:4]
        if b % 2 == 0:
            continue
        text = "\n".join(f"{n}. [{language}] {(rows[i]['text'] or '')[:120]}\n   [pl] {(rows[i]['text_pl'] or '')[:120]}" for n, i in enumerate(own, 1))
        try:
            said = json.loads(score([translation._RATE % (language, text)])[0])
            averages.append(float(said.get("avg", 3.0)))
        except (ValueError, AttributeError):
            continue
        low += [own[k] for k, m in enumerate(said.get("scores", [])) if m <= 2 and k < len(own)]
    n = 0
    for i in sorted(set(low)):
        near = lambda j: (rows[j]["text_pl"] or rows[j]["text"]) if 0 <= j < len(rows) else None
        before = " / ".join(t for t in (near(i - 2), near(i - 1)) if t)
        after = near(i + 1)
        text = rows[i]["text"] or ""
        p = translation._AGAIN % language + (f"Before: {before}\n" if before else "") + f"TRANSLATE: {text}" + (f"\nAfter: {after}" if after else "")
        new = (retry([p])[0] or "").strip()
        if new and new.lower() != text.lower():
            rows[i]["text_pl"], n = new, n + 1
    average = round(sum(averages) / len(averages), 2) if averages else None
    return rows, (sum(bool(r["text_pl"]) for r in rows), len(averages), average, n, average is None or average >= 3)


def made(rng, n, width):
    said = lambda i: rng.choice([None, "", f"t{i}", f"Wort {i} " * 30])
    return [{"seg_id": i * 2, "batch_id": i // width, "text": said(i), "text_pl": rng.choice(["", " ", "x"]) + f"p{i}|{rng.randint(1, 4)}"} for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 6])
def test_equal_to_the_loop(spark, width):
    rng = random.Random(width)
    recordings = {r: made(rng, rng.randint(1, 60), width) for r in range(12)}
    df = spark.createDataFrame([(r, *row.values()) for r, rows in recordings.items() for row in rows], KIND)
    final, report = translation.checked_translation(df, "de", score, retry)
    want = {r: looped(rows) for r, rows in recordings.items()}
    assert {(x.recording_id, x.seg_id): x.text_pl for x in final.collect()} == {(r, x["seg_id"]): x["text_pl"] for r, (rows, _) in want.items() for x in rows}
    assert {x.recording_id: tuple(x)[1:] for x in report.collect()} == {r: told for r, (_, told) in want.items()}
    assert sum(told[3] for _, told in want.values()) > 5


@pytest.mark.parametrize(("language", "text"), [("pl", "a"), ("auto", "b")])
def test_nothing_is_asked(spark, language, text):
    def never(prompts):
        raise AssertionError

    df = spark.createDataFrame([(1, i, i, "a", "b") for i in range(4)], KIND)
    final, report = translation.checked_translation(df, language, never, never)
    assert {r.text_pl for r in final.collect()} == {text}
    assert [tuple(r) for r in report.collect()] == [(1, 4, 0, None, 0, True)]
    none, empty = translation.checked_translation(df.limit(0), "de", never, never)
    assert none.count() == 0 and empty.count() == 0
