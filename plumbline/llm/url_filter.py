"""URL allow and block lists: a trie over reversed host labels, then path segments; the longest matching rule wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches

MAX_RULES = 1_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    return host.translate(LOWER), rest[: min(ends, default=len(rest))]


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class UrlTrie:
    """Rules ``(verdict, host, path)``. Host labels run from the last to the first, then path segments follow.

    A path matches as a prefix of characters, so the last segment of a rule may be part of a URL's segment: it hangs
    on its node as a ``tail``. Of two rules for one place, the longer (host and path) wins; of equal ones, block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        self.deepest = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.setdefault(label, {})
            # Keys that hold a slash can't be host labels.
            node = node.setdefault("/", {})
            *whole, tail = path.split("/")
            self.deepest = max(self.deepest, len(whole))
            for segment in whole:
                node = node.setdefault(segment, {})
            entry = (len(host) + len(path), verdict == "block", host + path)
            tails = node.setdefault("/tails", {})
            tails[tail] = max(entry, tails.get(tail, entry))
            node["/sizes"] = sorted(set(map(len, tails)))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """``(rule, verdict)`` of the longest rule that fits, or None."""
        best, node = None, self.root
        segments = path.split("/", self.deepest)
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            place = node.get("/")
            for segment in segments if place else ():
                # Only the lengths that rules have here, so a long segment costs no more than a short one.
                for size in place.get("/sizes", ()):
                    if size > len(segment):
                        break
                    found = place["/tails"].get(segment[:size])
                    if found and (best is None or found > best):
                        best = found
                place = place.get(segment)
                if place is None:
                    break
        return best and (best[2], "block" if best[1] else "allow")


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, longest matching rule and verdict of every row.

    One narrow pass, no shuffle; the trie is broadcast and bounded: more than ``MAX_RULES`` rules raise. Time is linear in a
    URL's length. Null URLs and those without ``://`` have an empty host and path, no rule and the default verdict. Ids
    may be null or repeat, and an empty table gives an empty result; extra columns are not read. An empty host label never
    fits a rule by accident, as rules name their labels.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES} at most")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(rows: dict) -> dict:
        hosts, paths, names, verdicts = [], [], [], []
        for url in rows["url"]:
            host, path = parts(url)
            found = trie.value.match(host, path)
            hosts.append(host)
            paths.append(path)
            names.append(found and found[0])
            verdicts.append(found[1] if found else default)
        return {"page_id": rows["page_id"], "host": hosts, "path": paths, "rule": names, "verdict": verdicts}

    return batches(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), judge, SCHEMA)
