"""The dependency graph of models: order, levels, cycles, affected and upstream nodes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class CycleError(ValueError):
    pass


class Dag:
    def __init__(self):
        self.parents: dict[str, set[str]] = {}
        self.children: dict[str, set[str]] = {}

    def add(self, node: str) -> None:
        self.parents.setdefault(node, set())
        self.children.setdefault(node, set())

    def edge(self, parent: str, child: str) -> None:
        self.add(parent)
        self.add(child)
        if parent != child:
            self.parents[child].add(parent)
            self.children[parent].add(child)

    def cycle(self) -> list[str] | None:
        state: dict[str, int] = {}
        for root in sorted(self.parents):
            path, todo = [], [(root, iter(sorted(self.children[root])))] if root not in state else []
            if todo:
                state[root] = 1
                path.append(root)
            while todo:
                node, rest = todo[-1]
                for c in rest:
                    if state.get(c) == 1:
                        return [*path[path.index(c) :], c]
                    if c not in state:
                        state[c] = 1
                        path.append(c)
                        todo.append((c, iter(sorted(self.children[c]))))
                        break
                else:
                    state[node] = 2
                    path.pop()
                    todo.pop()
        return None

    def levels(self) -> list[list[str]]:
        """Nodes by distance from the roots; those of one level don't depend on each other."""
        left = {n: len(p) for n, p in self.parents.items()}
        now, out = sorted(n for n, k in left.items() if not k), []
        while now:
            out.append(now)
            after = []
            for n in now:
                for c in self.children[n]:
                    left[c] -= 1
                    if not left[c]:
                        after.append(c)
            now = sorted(after)
        if sum(map(len, out)) < len(left):
            raise CycleError("circular dependency: " + " -> ".join(self.cycle() or []))
        return out

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    def _reach(self, start: Iterable[str], links: dict[str, set[str]]) -> set[str]:
        seen, todo = set(start), deque(start)
        while todo:
            for x in links.get(todo.popleft(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def affected(self, nodes: Iterable[str]) -> set[str]:
        return self._reach(list(nodes), self.children)

    def upstream(self, nodes: Iterable[str]) -> set[str]:
        return self._reach(list(nodes), self.parents)

    def roots(self) -> list[str]:
        return sorted(n for n, p in self.parents.items() if not p)

    def leaves(self) -> list[str]:
        return sorted(n for n, c in self.children.items() if not c)

    def subgraph(self, nodes: Iterable[str]) -> "Dag":
        keep, out = set(nodes), Dag()
        for n in keep:
            out.add(n)
            for p in self.parents[n] & keep:
                out.edge(p, n)
        return out
