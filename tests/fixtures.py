"""Generated test inputs (see FIXTURES.md): nothing here is copied from elsewhere."""

from __future__ import annotations

import json
import os
import random

ITEMS = [("cheese", 3, 3), ("milk", 1, 4), ("almonds", 1, 10)]


def order_line(ts: str, item: str, qty: int, cost: int, level: str = "INFO") -> str:
    return f"[{ts}] [{level}] Fulfilment - Order placed for {qty} items of {item} which costs {cost}"


def order_log_lines() -> list[str]:
    """The 512-request load mix: 210 cheese, 2 milk, 190 cheese, 10 almonds, 100 cheese."""
    mix = [("cheese", 210), ("milk", 2), ("cheese", 190), ("almonds", 10), ("cheese", 100)]
    spec = {name: (q, c) for name, q, c in ITEMS}
    out, sec = [], 0
    for name, n in mix:
        q, c = spec[name]
        for _ in range(n):
            out.append(order_line(f"2019-08-23T15:{50 + sec // 3600:02d}:{(sec // 60) % 60:02d}.{sec % 1000:03d}",
                                  name, q, c))
            sec += 7
    return out


def write_log_tree(root: str) -> str:
    rng = random.Random(5)
    for f in range(30):
        d = os.path.join(root, f"app_{f:02d}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "sample.log"), "w") as fh:
            for i in range(10):
                item, q, c = ITEMS[0] if rng.random() < 0.9 else ITEMS[1]
                fh.write(order_line(f"2019-08-23T15:50:{i:02d}.{f:03d}", item, q, c) + "\n")
    with open(os.path.join(root, "orders-500.log"), "w") as fh:
        fh.write("\n".join(order_log_lines()) + "\n")
    return root


def _code(k: int) -> str:
    s = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        s = chr(97 + r) + s
    return s


def hadoop_records(n: int = 2000, n_templates: int = 141, seed: int = 50) -> list[dict]:
    rng = random.Random(seed)
    recs = []
    for i in range(n):
        t = i % n_templates if i < n_templates else rng.randrange(n_templates)
        msg = (f"INFO [main] org.example.mapreduce.Component{_code(t).capitalize()}: "
               f"handled {rng.randrange(1000)} records in {rng.randrange(100)} ms")
        recs.append({"message": msg})
    return recs


def write_hadoop_json(path: str, nested: bool = False) -> str:
    recs = hadoop_records()
    if nested:
        recs = [dict(r, k8s={"pod": f"pod-{i % 3}", "ns": "default"}, tags=["a", str(i % 2)])
                for i, r in enumerate(recs)]
    with open(path, "w") as fh:
        json.dump(recs, fh)
    return path


def false_positive_events() -> list[str]:
    """10,000 messages of three templates: 9,786 / 213 / 1."""
    return (["DEBUG Processed 12 out of 40 packages"] * 9786
            + ["Thread odcs server INFO Compose type state done Compose done"] * 213
            + ["root CMD usr local bin monitor apache stats sh dev null"])
