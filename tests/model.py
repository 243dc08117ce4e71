"""A step-by-step registry, queue and fan-out, to compare the folded results with."""

from __future__ import annotations

import re
from collections import deque
from datetime import datetime

OPEN_END = datetime(9999, 1, 1)


def endpoint_ok(address) -> bool:
    if not isinstance(address, str):
        raise TypeError
    found = re.match(r"(grpcs?://)?([a-zA-Z0-9.-]+|\[[0-9a-fA-F:]+\]):([0-9]{1,5})$", address)
    return bool(found) and 1 <= int(found.group(3)) <= 65535


class Registry:
    def __init__(self, topics):
        self.members = {t: set() for t in topics}

    def step(self, action, topic, address, check=True):
        """The answer of a client action; None for a topic action."""
        if action == "add_topic":
            self.members[topic] = set()
            return None
        if action == "remove_topic":
            self.members.pop(topic, None)
            return None
        if action not in ("subscribe", "unsubscribe"):
            return "exception"
        if (check and not endpoint_ok(address)) or topic not in self.members:
            return "error"
        if action == "subscribe":
            self.members[topic].add(address)
        else:
            self.members[topic].discard(address)
        return "Success"


def replay_control(control, initial, points=(), check=True):
    """Answers by seq, members at the end, and (topic, number, address) for points (topic, number, ts)."""
    registry, answers, delivered = Registry(initial), {}, []
    steps = [((c["ts"], 0, c["seq"]), "control", c) for c in control]
    # An action at the time of a flight is seen by it.
    steps += [((p[2], 1, p[1]), "point", p) for p in points]
    for _, kind, item in sorted(steps, key=lambda s: s[0]):
        if kind == "control":
            answer = registry.step(item["action"], item["topic"], item["address"], check)
            if answer:
                answers[item["seq"]] = answer
        else:
            delivered += [(item[0], item[1], a) for a in registry.members.get(item[0], ())]
    return answers, registry.members, delivered


def flights(events, n):
    """(topic, number, time) of flights of at most n events (topic, ts, id)."""
    queues, found = {}, []
    for topic, ts, number in sorted(events, key=lambda e: (e[1], e[2])):
        queues.setdefault(topic, deque()).append(ts)
    for topic, queue in queues.items():
        flight = 0
        while queue:
            chunk = [queue.popleft() for _ in range(min(n, len(queue)))]
            found.append((topic, flight, chunk[-1], len(chunk)))
            flight += 1
    return found


def queue(ops):
    """(depth, bytes) after each operation (op, size)."""
    waiting, out = deque(), []
    for op, size in ops:
        if op == "write":
            waiting.append(size)
        elif waiting:
            waiting.popleft()
        out.append((len(waiting), sum(waiting)))
    return out
