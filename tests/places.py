"""Plain versions of rules on trees and graphs."""


def tree_place(place: int, n: int) -> tuple[int, int]:
    """Rank before (root, left, right) and after (left, right, root) its subtrees of the item at ``place`` of n in a balanced tree of midpoints."""
    lo, hi, pre, post = 0, n - 1, 0, 0
    while True:
        mid = (lo + hi) // 2
        left, right = mid - lo, hi - mid
        if place == mid:
            return pre, post + left + right
        if place < mid:
            pre, hi = pre + 1, mid - 1
        else:
            pre, post, lo = pre + 1 + left, post + left, mid + 1


def least_reaching(links: list[tuple[int, int]], directed: bool) -> dict[int, int]:
    """The smallest node that reaches each node with a link to another: seeds in ascending order take all they reach."""
    after: dict[int, set[int]] = {}
    for u, v in links:
        if u != v:
            after.setdefault(u, set()).add(v)
            after.setdefault(v, set()).update(() if directed else (u,))
    root: dict[int, int] = {}
    for s in sorted(after):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = s
                todo += after[x]
    return root
