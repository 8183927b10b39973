"""Many reads at a time within one task, with bounds a lane: at most one at a time and so many a minute.

A lane is whatever must not be asked too fast: a host, a share of a host, a key
of a service.  Reads that are told to wait (429 with or without a delay, time
outs, lost connections) are tried again after others of their lane had
their turn.  A deadline ends what has not answered by then.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Hashable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace

from .http import Reply

#: Outcomes after which another try may succeed.
PASSING = ("rate_limited", "timeout", "network")


@dataclass(frozen=True)
class Policy:
    """Bounds of a task's reads: threads, calls a minute of each lane (0: any), tries, and the longest wait for one of them in seconds."""

    threads: int = 8
    per_minute: int = 0
    tries: int = 3
    longest_wait: float = 30.0
    first_wait: float = 0.5
    held: int = 1024  # requests that a task looks ahead


@dataclass
class Lane:
    """The requests of a lane in order: [request, tries so far, not before], and the times of its calls in the last minute."""

    queue: deque = field(default_factory=deque)
    calls: deque = field(default_factory=deque)
    busy: bool = False

    def ready_at(self, policy: Policy, now: float) -> float:
        """When its first request may go."""
        while self.calls and self.calls[0] <= now - 60:
            self.calls.popleft()
        full = policy.per_minute and len(self.calls) >= policy.per_minute
        return max(self.queue[0][2], self.calls[-policy.per_minute] + 60 if full else 0.0)


def run(requests: Iterable[object], lane_of: Callable[[object], Hashable], read: Callable[[object], Reply], policy: Policy, deadline: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[object, Reply, int]]:
    """(request, reply, tries) of every request, as they end; at ``deadline`` (by ``clock``) the rest are ``deadline`` errors.

    Requests are taken from the iterable as there is room, ``held`` of them at most.
    """
    source, lanes, open_, done = iter(requests), {}, {}, False
    left = 0
    pool = ThreadPoolExecutor(policy.threads)
    try:
        while True:
            while not done and left < policy.held:
                try:
                    r = next(source)
                except StopIteration:
                    done = True
                    break
                lanes.setdefault(lane_of(r), Lane()).queue.append([r, 0, 0.0])
                left += 1
            if done and not left:
                return
            now = clock()
            if deadline is not None and now >= deadline:
                break
            soonest = None
            for name, lane in list(lanes.items()):
                if lane.busy or len(open_) >= policy.threads:
                    continue
                if not lane.queue:
                    if not lane.calls or lane.calls[-1] <= now - 60:
                        del lanes[name]  # nothing to remember
                    continue
                at = lane.ready_at(policy, now)
                if at > now:
                    soonest = at if soonest is None else min(soonest, at)
                    continue
                item = lane.queue.popleft()
                lane.busy = True
                lane.calls.append(now)
                open_[pool.submit(read, item[0])] = (lane, item)
            until = min(x for x in (soonest, deadline, now + 60) if x is not None) - now
            if not open_:
                sleep(max(until, 0.001))
                continue
            for f in wait(open_, timeout=max(until, 0.001), return_when=FIRST_COMPLETED).done:
                lane, (r, tries, _) = open_.pop(f)
                lane.busy = False
                reply, tries = f.result(), tries + 1
                pause = reply.retry_after if reply.retry_after is not None else policy.first_wait * 2 ** (tries - 1)
                if reply.error_kind in PASSING and tries < policy.tries and pause <= policy.longest_wait:
                    lane.queue.append([r, tries, clock() + pause])
                else:
                    left -= 1
                    yield r, reply, tries
        late = Reply("", "deadline")
        for _, (r, tries, _) in open_.values():
            yield r, late, tries + 1
        for lane in lanes.values():
            for r, tries, _ in lane.queue:
                yield r, late, tries
        for r in source:
            yield r, late, 0
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def named(reply: Reply, url: str) -> Reply:
    """The reply with the address that was asked where it has none."""
    return reply if reply.final_url else replace(reply, final_url=url)
