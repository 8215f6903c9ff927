"""Secret scans: samples silence only their own part, and the query's counts and spans by the contract's patterns as they are written there."""

import hashlib
import re

import pytest

from cellweave.llm import queries, secret_scan

SF = "/root/testdata/sf0.001"
KEY = "Zq8Rk2Lw9Tx4Vb7Nm1Pc6Yd3"


@pytest.mark.parametrize("joint", ["/", "_", "-", "+"])
def test_a_key_beside_a_sample(joint):
    for text in (f"example{joint}{KEY}", f"{KEY}{joint}EXAMPLE", f"see xxxx{joint}{KEY}{joint}0123456789 here"):
        assert [k for _, k, _ in secret_scan.find(text)] == [3]
    for text in (f"example{joint}words", f"EXAMPLE{KEY}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", f"xxxx{joint}" * 20):
        assert secret_scan.find(text) == []


def plain(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_registered_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_secret_scans"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        for kind, n in (("assign", r.n_assign), ("access", r.n_access), ("hex", r.n_hex)):
            assert n == sum(s.startswith(kind) for s in base)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("entropy")] == base
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(0 <= int(a) < int(b) <= len(docs[r.doc_id]) for _, a, b in (s.split(":") for s in spans))
