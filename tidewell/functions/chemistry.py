"""Read layouts: barcode segments, linkers and the patterns that find them."""

from __future__ import annotations

from dataclasses import dataclass


def _rc(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@dataclass(frozen=True)
class Chemistry:
    """Segment lengths, UMI length and linkers, in forward order."""

    name: str
    segments: tuple[int, ...]
    umi: int
    linkers: tuple[str, ...]

    def pattern(self, reverse: bool, anchored: bool = True) -> tuple[str, tuple[str, ...]]:
        """The pattern of a strand and its group names.

        ``anchored`` starts each match at the beginning of a run of ACGT, as a
        greedy leading run does anyway; without it a backtracking engine needs
        quadratic time on reads that don't match.
        """
        parts: list[tuple[str, str]] = []
        for i, n in enumerate(self.segments):
            parts.append((f"bc{i + 1}", f"[ACGT]{{{n}}}"))
            if i < len(self.linkers):
                parts.append(("", self.linkers[i]))
        parts.append(("umi", f"[ACGT]{{{self.umi}}}"))
        if reverse:
            parts = [(name, p if name else _rc(p)) for name, p in reversed(parts)]
            parts = [("seq", "[ACGT]*"), *parts, ("flank", "[ACGT]*")]
        else:
            parts = [("flank", "[ACGT]*"), *parts, ("seq", "[ACGT]*")]
        names = tuple(name for name, _ in parts if name)
        body = "".join(f"({p})" if name else p for name, p in parts)
        return ("(?<![ACGT])" if anchored else "") + body, names


# The lengths and linkers of the supported layout.
PIPSEQ_V4 = Chemistry("pipseq_v4", (8, 6, 6, 8), 12, ("ATG", "GAG", "TCGAG"))
CHEMISTRIES = {PIPSEQ_V4.name: PIPSEQ_V4}
