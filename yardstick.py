"""Time a few operators in plain single-thread Python over the same documents, to set beside bench.py.

Prints one JSON line of seconds; reading the table is not counted, as it is in neither.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections import defaultdict

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
LIMIT = 5000


def restore(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", "SOURCE TEXT\n" + text.replace(". ", ".  \r\n\r\n\r\n-\n")).removeprefix("SOURCE TEXT\n")
    text = re.sub(r"-\n([A-Za-z])", r"\1", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip() + "\n"


def pack(parts: list[str], gap: str) -> list[str]:
    out: list[list[str]] = []
    size = LIMIT + 1
    for p in parts:
        fits = size + len(gap) + len(p) <= LIMIT
        size = size + len(gap) + len(p) if fits else len(p)
        out[-1].append(p) if fits else out.append([p])
    return [gap.join(x) for x in out]


def split(text: str) -> list[str]:
    text = text.strip()
    if len(text) <= LIMIT:
        return [text] if text else []
    packed = pack([b for b in (x.strip() for x in re.split(r"\n{2,}", text)) if b], "\n\n")
    return [c for b in packed for c in ([b] if len(b) <= LIMIT else pack([x.strip() for x in b.splitlines() if x.strip()], "\n"))]


def line_dedup(rows: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    keyed = [[x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (d, _), keys in zip(rows, keyed):
        for k in keys:
            if len(k) >= 20:
                holders[k].add(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for (d, t), keys in zip(rows, keyed):
        kept = [x for x, k in zip(t.split("\n"), keys) if last.get(k, d) == d]
        out.append((d, len(keys) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def repeats(text: str) -> int:
    words = text.split()
    seen: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})


def main() -> None:
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"])
    rows = [(d, t or "") for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist())]
    jobs = {
        "restore_text_offline": lambda: [restore(t) for _, t in rows],
        "split_chunks": lambda: [[hashlib.md5(c.encode()).hexdigest() for c in split(t)] for _, t in rows],
        "op10_line_dedup": lambda: line_dedup(rows),
        "op8_quality_rules (counts of the text only)": lambda: [repeats(t) for _, t in rows],
    }
    took = {}
    for name, job in jobs.items():
        began = time.time()
        job()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds of single-thread Python", "queries": took, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
