from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexifold.functions import replies
from lexifold.operators import proposals

WHOLE = "PROPOSAL\nslug: a\nfolder: skills/x\nsummary: One line..\nkeys: k1, `k2`, ,k3\nsources: s-1, s-2,s-1\nbody:\n  first\n\nslug: in body\nEND"


def brute_blocks(text):
    out, lines = [], iter((text or "").replace("\r\n", "\n").split("\n"))
    for line in lines:
        if line.strip() != "PROPOSAL":
            continue
        head, body, inside = {"folder": ""}, [], False
        for own in lines:
            bare = own.strip()
            if bare == "END":
                break
            if inside:
                body.append(own)
            elif bare == "body:":
                inside = True
            elif (name := bare.split(":")[0]) in ("slug", "folder", "summary", "keys", "sources") and ":" in bare:
                head[name] = bare[len(name) + 1 :].strip()
        listed = lambda n: [s.strip() for s in head.get(n, "").split(",")]
        row = {"slug": head.get("slug", ""), "folder": head["folder"] or "knowledge", "summary": head.get("summary", "").rstrip("."), "keys": [k for k in (k.strip("`") for k in listed("keys")) if k], "sources": [s for s in listed("sources") if s], "body": "\n".join(body).strip()}
        out.append(row | {"refused": [n for n in ("slug", "summary", "keys", "body") if not row[n]]})
    return out


def brute_review(text):
    bare = lambda s: s.strip().lstrip("-*>#`").strip().replace("**", "").replace("__", "").strip()
    lines = [bare(s) for s in (text or "").replace("\r\n", "\n").split("\n")]
    accept, reason = None, ""
    for s in lines:
        head, colon, rest = s.partition(":")
        if colon and head.strip().lower() == "verdict":
            accept = False if "reject" in rest.lower() else True if "accept" in rest.lower() else accept
        elif colon and head.strip().lower() == "reason":
            reason = reason or rest.strip()
    if accept is None:
        alone = [s.lower().rstrip(".") for s in lines]
        accept = next((a.startswith("accept") for a in alone if a in ("reject", "rejected", "accept", "accepted")), None)
    if accept is None:
        seen = " ".join((text or "").split())[:200]
        return False, False, f"no verdict: {seen}" if seen else "nothing was returned"
    return accept, True, reason or "no reason given"


def brute_refused(text):
    out, inside = [], False
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        s = line.strip()
        if s.startswith("#"):
            inside = any(s.startswith(f"{marks} {title}") for marks in ("#", "##") for title in replies.REFUSED)
        elif inside and s.startswith("- "):
            out.append(s[2:].strip())
    return out


PIECES = {
    "blocks": ["PROPOSAL", "  PROPOSAL \t", "PROPOSALS", "END", " END ", "slug: a", "slug:", " slug :b", "summary: x.", "summary: .", "keys: a, `b`,,``", "keys:", "folder: f", "sources: s,t", "body:", " body: ", "body: x", "text", "", "é\u00a0", "\r"],
    "reviews": ["VERDICT: accept", "**Verdict** : Rejected, not accept", "> verdict: maybe", "- reason: because: so", "Reason:", "`REASON : é`", "accept.", "### Rejected..", "I accept", "", "__verdict__:accept", "verdict", "\u00a0"],
    "refused": ["## Refusals", "# Refusals of today", "### Refusals", "## Questions the base could not answer", "## Other", "#tag", "- one", "  -  two ", "-", "- ", "-x", "text - y", "", "* z"],
}


def random_texts(kind, n=400):
    rng = random.Random(7)
    return [rng.choice(["\n", "\n", "\r\n"]).join(rng.choices(PIECES[kind], k=rng.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("kind, column, brute", [
    ("blocks", replies.proposals, brute_blocks),
    ("reviews", replies.review, brute_review),
    ("refused", replies.refused_questions, brute_refused),
])
def test_as_line_by_line(spark, kind, column, brute):
    texts = [None, "", WHOLE, WHOLE.replace("\nEND", ""), WHOLE + "\nPROPOSAL\nEND\n" + WHOLE, "line\n" * 50_000 + WHOLE + "\n" + "- x\n" * 50_000, "## Refusals\n" + "- q\n" * 20_000, *random_texts(kind)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column(F.col("text")).alias("r")).collect()
    for i, got in rows:
        plain = [b.asDict() for b in got] if kind == "blocks" else tuple(got) if kind == "reviews" else list(got)
        assert plain == brute(texts[i]), repr(texts[i])[:300]


def test_decided(spark):
    texts = [("r1", WHOLE + "\n" + WHOLE.replace("slug: a", "slug: b")), ("r2", WHOLE), ("r3", WHOLE.replace("s-2,s-1", "s-9, s-8")), ("r4", WHOLE.replace(", s-2,s-1", "").replace("slug: a", "slug: c")), ("r5", "NOTHING"), ("r6", WHOLE.replace("slug: a", "slug: d")), ("r7", None)]
    blocks = proposals.blocks(spark.createDataFrame(texts, "reply string, text string"))
    known = proposals.borne_out(blocks, spark.createDataFrame([("s-1",), ("s-2",), ("s-2",), (None,)], "session string"))
    says = [("r1", 1, "fit", "verdict: accept"), ("r1", 1, "true", "Accepted."), ("r2", 1, "fit", "accept"), ("r1", 2, "true", "verdict: reject\nreason: no"), ("r1", 2, "new", "who knows"), ("r4", 1, "fit", "accept")]
    reviews = spark.createDataFrame(says, "reply string, block int, lens string, text string")
    got = {(r.reply, r.block): (r.slug, r.written, r.reason) for r in proposals.decided(known, reviews).collect()}
    assert got == {
        ("r1", 1): ("a", True, ""), ("r1", 2): ("b", False, "new: no verdict: who knows"), ("r2", 1): ("a", False, "taken"),
        ("r3", 1): ("a", False, "unknown s-8"), ("r4", 1): ("c", False, "sessions"), ("r6", 1): ("d", False, "not reviewed"),
    }
