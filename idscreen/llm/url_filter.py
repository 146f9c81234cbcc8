"""URL filters: all glob rules run at once over each canonical URL as one bit-parallel automaton.

Every rule is a row of states in multiword Shift-And masks: a state means how many fixed characters of the rule have
been read, a wildcard is a state that may stay where it is. One step of all rules over one character is a shift, two
table look-ups and an OR on machine words, and a whole batch of URLs is stepped together.

Cases: a null url or one without `://` has an empty host and path; an empty table gives an empty result; other
columns are never looked at. A long url only lengthens its own walk: finished urls leave the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import binary_values


@dataclass(frozen=True)
class UrlRule:
    """A host with all its subdomains and the beginning of a path, e.g. allow example.com/en/."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


@dataclass(frozen=True)
class UrlGlob:
    """A glob over the canonical URL (host and path): ? is one character, * stays within a part, ** does not."""

    verdict: str
    glob: str


def compiled(globs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, stay, start, ends): byte masks [256, words], the first states [words], each rule's last state [rules, 2]."""
    layouts = []
    size = 0
    for glob in globs:
        literals: list[int] = []
        stays: dict[int, bool] = {}
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i : i + 1] == b"*":
                wide = raw[i : i + 2] == b"**"
                stays[len(literals)] = wide or stays.get(len(literals), False)
                i += 2 if wide else 1
            else:
                literals.append(raw[i])
                i += 1
        layouts.append((size, literals, stays))
        size += len(literals) + 1
    words = max(1, -(-size // 64))
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, ends = np.zeros(words, np.uint64), np.zeros((len(globs), 2), np.int64)

    def bit(state: int) -> tuple[int, np.uint64]:
        return state // 64, np.uint64(1 << (state % 64))

    for rule, (first, literals, stays) in enumerate(layouts):
        word, mask = bit(first)
        start[word] |= mask
        for k, char in enumerate(literals):
            word, mask = bit(first + k + 1)
            accepted = range(256) if char == ord("?") else (char,)
            for c in accepted:
                step[c, word] |= mask
        for k, wide in stays.items():
            word, mask = bit(first + k)
            for c in range(256):
                if wide or c != ord("/"):
                    stay[c, word] |= mask
        ends[rule] = divmod(first + len(literals), 64)
    return step, stay, start, ends


def matches(urls: Sequence[bytes], automaton: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """[urls, rules] booleans: which rules match each whole url."""
    step, stay, start, ends = automaton
    order = sorted(range(len(urls)), key=lambda k: -len(urls[k]))
    lengths = np.array([len(urls[k]) for k in order], np.int64)
    flat = np.frombuffer(b"".join(urls[k] for k in order), np.uint8)
    begins = np.cumsum(lengths) - lengths
    state = np.tile(start, (len(urls), 1))
    active = len(urls)
    for position in range(int(lengths[0]) if len(urls) else 0):
        active = int(np.searchsorted(-lengths, -position))  # urls longer than position; sorted, so they come first
        char = flat[begins[:active] + position]
        now = state[:active]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[:active] = (moved & step[char]) | (now & stay[char])
    found = np.empty((len(urls), len(ends)), bool)
    found[order] = (state[:, ends[:, 0]] >> ends[:, 1].astype(np.uint64)) & np.uint64(1)
    return found


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """(host, path): host with A-Z lower-cased, path up to `?` or `#`; both empty without `://`."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    globs: Sequence[UrlGlob] = (),
    default: str = "allow",
    id_col: str = "page_id",
    url: str = "url",
    batch_urls: int = 4_096,
) -> DataFrame:
    """(id, host, path, rule, verdict): the longest host rule that fits decides; else a glob, block before allow; else
    the default.

    The rule sets are the caller's own short lists and travel with the task. No shuffle; only two columns are read.
    """
    ranked = sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text))
    own = [g for r in ranked for g in r.globs()]
    after = sorted(globs, key=lambda g: g.verdict == "block")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled([*own, *(g.glob for g in after)])
        for whole in batches:
            for offset in range(0, whole.num_rows, batch_urls):
                batch = whole.slice(offset, batch_urls)
                parts = [split_url(u) for u in binary_values(batch.column(1))]
                found = matches([h + p for h, p in parts], automaton)
                rule = np.full(len(parts), None, object)
                verdict = np.full(len(parts), default, object)
                for k, g in enumerate(after):
                    verdict[found[:, len(own) + k]] = g.verdict
                for k, r in enumerate(ranked):  # a longer rule comes later and overwrites
                    fits = found[:, 2 * k] | found[:, 2 * k + 1]
                    rule[fits], verdict[fits] = r.text, r.verdict
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([h.decode() for h, _ in parts], pa.string()),
                        pa.array([p.decode() for _, p in parts], pa.string()),
                        pa.array(rule.tolist(), pa.string()),
                        pa.array(verdict.tolist(), pa.string()),
                    ],
                    names=[id_col, "host", "path", "rule", "verdict"],
                )

    narrow = pages.select(F.col(id_col), F.col(url).alias("_url"))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
