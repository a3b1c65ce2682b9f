"""Text formats of sequences and alignments: parsers to plain records, and writers."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

WIDTH = 60


@dataclass
class Record:
    name: str
    seq: str
    accession: str | None = None
    description: str | None = None


@dataclass
class Alignment:
    names: list[str] = field(default_factory=list)
    rows: list[str] = field(default_factory=list)
    id: str | None = None
    accession: str | None = None
    description: str | None = None
    #: (kind, sequence name or None, tag, text) in file order; kinds gf, gs, gc, gr.
    markup: list[tuple[str, str | None, str, str]] = field(default_factory=list)

    def checked(self) -> Alignment:
        if not self.rows or len({len(r) for r in self.rows}) != 1 or not self.rows[0]:
            raise ValueError("rows of unequal or no length")
        if len(set(self.names)) != len(self.names):
            raise ValueError("names repeat")
        return self

    def column(self, tag: str) -> str | None:
        return next((t for k, _, g, t in self.markup if k == "gc" and g == tag), None)

    def weights(self) -> list[float] | None:
        found = {n: float(t) for k, n, g, t in self.markup if k == "gs" and g == "WT"}
        return [found[n] for n in self.names] if found.keys() >= set(self.names) else None


#: Extension and format.
EXTENSIONS = {
    "sto": "stockholm", "stk": "stockholm", "afa": "afa", "a2m": "a2m", "phy": "phylip", "slx": "selex", "selex": "selex", "pb": "psiblast",
    "fa": "fasta", "fasta": "fasta", "fna": "fasta", "faa": "fasta", "gb": "genbank", "gbk": "genbank", "genbank": "genbank", "embl": "embl",
}


def detect(head: str) -> str | None:
    """The format that the first line that is not blank shows."""
    text = head.lstrip()
    line = text.split("\n", 1)[0]
    if text.startswith(">"):
        return "fasta"
    if text.startswith("# STOCKHOLM"):
        return "stockholm"
    if text.startswith("LOCUS") or "Genetic Sequence Data Bank" in line:
        return "genbank"
    if text.startswith("ID   "):
        return "embl"
    if text.startswith("CLUSTAL") or "multiple sequence alignment" in line:
        return "clustal"
    return "phylip" if re.fullmatch(r"\s*\d+\s+\d+\s*", line) else None


def detect_name(path: str) -> str | None:
    stem = path[:-3] if path.endswith(".gz") else path
    return EXTENSIONS.get(stem.rsplit(".", 1)[-1].lower())


def decoded(content: bytes) -> str:
    """Text, uncompressed if it begins as gzip does."""
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8")


def lines_of(content: bytes) -> Iterator[str]:
    """The lines of ``decoded``, of which one is held at a time."""
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    for line in io.TextIOWrapper(stream, "utf-8"):
        yield from line.splitlines()


def begun(lines: Iterator[str]) -> tuple[str, Iterator[str]]:
    """The lines up to the first that is not blank, which is what ``detect`` looks at, and all lines again."""
    head = []
    for line in lines:
        head.append(line)
        if line.strip():
            break
    return "\n".join(head), chain(head, lines)


def fasta_records(lines: Iterable[str]) -> Iterator[Record]:
    """A record from each line that begins with ``>``: name, the rest of the line for a description, and the
    following lines without white space. Empty sequences are read."""
    now: Record | None = None
    parts: list[str] = []
    for line in lines:
        if line.startswith(">"):
            if now is not None:
                now.seq = "".join(parts)
                yield now
            head = line[1:].split(None, 1)
            now = Record(head[0] if head else "", "", None, head[1].strip() if len(head) > 1 else None)
            parts = []
        elif line.strip():
            if now is None:
                raise ValueError("no > at the start")
            parts.append("".join(line.split()))
    if now is not None:
        now.seq = "".join(parts)
        yield now


def parse_fasta(text: str) -> list[Record]:
    return list(fasta_records(text.splitlines()))


def wrapped(text: str, width: int) -> str:
    return text if width <= 0 else "\n".join(text[i : i + width] for i in range(0, len(text), width))


def write_fasta(records: list[Record], width: int = WIDTH) -> str:
    line = lambda r: ">" + " ".join(x for x in (r.name, r.accession, r.description) if x)
    return "".join(f"{line(r)}\n{wrapped(r.seq, width)}\n" if r.seq else f"{line(r)}\n" for r in records)


def _flat(text: Iterable[str], first: str) -> Iterator[list[str]]:
    """The lines of each record that ends with //."""
    any_, lines = False, []
    for line in text:
        if line.startswith("//"):
            if lines:
                any_ = True
                yield lines
            lines = []
        elif lines or line.startswith(first):
            lines.append(line)
        elif line.strip() and not any_ and first != "LOCUS":
            raise ValueError(f"no {first.strip()} at the start")
    if lines:
        raise ValueError("no // at the end")


_NO_LETTERS = re.compile("[^A-Za-z]+")


def _letters(lines: list[str]) -> str:
    text = "".join(lines)
    return _NO_LETTERS.sub("", text) if text.isascii() else "".join(c for c in text if c.isalpha())


def genbank_records(text: Iterable[str]) -> Iterator[Record]:
    """LOCUS name, DEFINITION over its lines, VERSION for an accession, ORIGIN letters. A preamble is skipped."""
    for lines in _flat(text, "LOCUS"):
        r, section, origin, definition = Record(lines[0].split()[1], ""), "", [], []
        for line in lines:
            key = line[:12].strip() if line[:1] != " " else ""
            section = key or section
            if section == "DEFINITION":
                definition.append(line[12:].strip())
            elif key == "VERSION":
                r.accession = (line[12:].split() or [None])[0]
            elif section == "ORIGIN" and not key:
                origin.append(line)
        r.description, r.seq = " ".join(definition) or None, _letters(origin).upper()
        yield r


def parse_genbank(text: str) -> list[Record]:
    return list(genbank_records(text.splitlines()))


def embl_records(text: Iterable[str]) -> Iterator[Record]:
    """ID, the first AC, DE lines joined, the letters after SQ."""
    for lines in _flat(text, "ID   "):
        r = Record(lines[0][5:].split()[0].rstrip(";"), "")
        r.accession = next((x[5:].split(";")[0].strip() for x in lines if x.startswith("AC   ")), None)
        r.description = " ".join(x[5:].strip() for x in lines if x.startswith("DE   ")) or None
        start = next((i for i, x in enumerate(lines) if x.startswith("SQ   ")), len(lines))
        r.seq = _letters(lines[start + 1 :]).upper()
        yield r


def parse_embl(text: str) -> list[Record]:
    return list(embl_records(text.splitlines()))


def _blocks(seq: str) -> list[str]:
    """Lines of six blocks of ten, lower case."""
    return [" ".join(seq[i + j : i + j + 10] for j in range(0, min(60, len(seq) - i), 10)).lower() for i in range(0, len(seq), 60)]


def write_genbank(records: list[Record]) -> str:
    out = []
    for r in records:
        out.append(f"LOCUS       {r.name:<16} {len(r.seq):>11} bp")
        out.append(f"DEFINITION  {r.description or '.'}")
        if r.accession:
            out += [f"ACCESSION   {r.accession.split('.')[0]}", f"VERSION     {r.accession}"]
        out.append("ORIGIN")
        out += [f"{60 * i + 1:>9} {b}" for i, b in enumerate(_blocks(r.seq))]
        out.append("//")
    return "\n".join(out) + "\n" if out else ""


def write_embl(records: list[Record]) -> str:
    out = []
    for r in records:
        out.append(f"ID   {r.name}; SV 1; linear; {len(r.seq)} BP.")
        out += [f"AC   {r.accession};"] if r.accession else []
        out += [f"DE   {r.description}"] if r.description else []
        out.append(f"SQ   Sequence {len(r.seq)} BP;")
        out += [f"     {b:<66}{min(60 * (i + 1), len(r.seq)):>9}" for i, b in enumerate(_blocks(r.seq))]
        out.append("//")
    return "\n".join(out) + "\n" if out else ""


def parse_afa(text: str) -> Alignment:
    records = parse_fasta(text)
    return Alignment([r.name for r in records], [r.seq for r in records]).checked()


def write_afa(a: Alignment, width: int = WIDTH) -> str:
    return write_fasta([Record(n, s) for n, s in zip(a.names, a.rows)], width)


def parse_stockholm(text: str) -> list[Alignment]:
    """All alignments of a file, each with its header and closed by //; blocks may be interleaved."""
    out: list[Alignment] = []
    now, parts, marks = None, {}, {}
    for line in text.splitlines():
        if now is None:
            if not line.strip():
                continue
            if not line.startswith("# STOCKHOLM 1."):
                raise ValueError("no # STOCKHOLM header")
            now, parts, marks = Alignment(), {}, {}
        elif line.startswith("//"):
            now.names, now.rows = list(parts), ["".join(p) for p in parts.values()]
            now.markup += [(k, n, t, "".join(v)) for (k, n, t), v in marks.items()]
            if any(k == "gc" and len(t) != len(now.rows[0] if now.rows else "") for k, _, _, t in now.markup):
                raise ValueError("column markup of another length")
            out.append(now.checked())
            now = None
        elif line.startswith("#=GF"):
            _, tag, value = (line.split(None, 2) + [""])[:3]
            now.markup.append(("gf", None, tag, value))
            known = {"ID": "id", "AC": "accession", "DE": "description"}
            if tag in known:
                setattr(now, known[tag], value.strip())
        elif line.startswith("#=GS"):
            _, name, tag, value = (line.split(None, 3) + [""])[:4]
            now.markup.append(("gs", name, tag, value))
        elif line.startswith("#=GC"):
            _, tag, value = line.split(None, 2)
            marks.setdefault(("gc", None, tag), []).append(value.strip())
        elif line.startswith("#=GR"):
            _, name, tag, value = line.split(None, 3)
            marks.setdefault(("gr", name, tag), []).append(value.strip())
        elif line.strip() and not line.startswith("#"):
            name, row = line.split(None, 1)
            parts.setdefault(name, []).append("".join(row.split()))
    if now is not None:
        raise ValueError("no // at the end")
    return out


def write_stockholm(a: Alignment, width: int = 200) -> str:
    """Blocks of ``width`` columns, one block if it is 0."""
    n = len(a.rows[0])
    width = width or n
    out = ["# STOCKHOLM 1.0", ""]
    told = {t for k, _, t, _ in a.markup if k == "gf"}
    out += [f"#=GF {t} {v}" for t, v in (("ID", a.id), ("AC", a.accession), ("DE", a.description)) if v and t not in told]
    out += [f"#=GF {t} {v}" for k, _, t, v in a.markup if k == "gf"]
    out += [f"#=GS {m} {t} {v}" for k, m, t, v in a.markup if k == "gs"]
    pad = max([len(x) for x in a.names] + [len(f"#=GR {m} {t}") if k == "gr" else len(f"#=GC {t}") for k, m, t, _ in a.markup if k in ("gr", "gc")])
    for lo in range(0, n, width):
        out.append("")
        for name, row in zip(a.names, a.rows):
            out.append(f"{name:<{pad}} {row[lo : lo + width]}")
            out += [f"{f'#=GR {m} {t}':<{pad}} {v[lo : lo + width]}" for k, m, t, v in a.markup if k == "gr" and m == name]
        out += [f"{f'#=GC {t}':<{pad}} {v[lo : lo + width]}" for k, _, t, v in a.markup if k == "gc"]
    return "\n".join([*out, "//", ""])


def _interleaved(lines: list[str]) -> Alignment:
    parts: dict[str, list[str]] = {}
    for line in lines:
        name, *row = line.split()
        parts.setdefault(name, []).append("".join(x for x in row if not x.isdigit()))
    return Alignment(list(parts), ["".join(p) for p in parts.values()]).checked()


def parse_clustal(text: str) -> Alignment:
    head, *lines = text.lstrip().splitlines()
    if not (head.startswith("CLUSTAL") or "multiple sequence alignment" in head):
        raise ValueError("no CLUSTAL header")
    return _interleaved([x for x in lines if x.strip() and not x[0].isspace()])


def write_clustal(a: Alignment) -> str:
    """Blocks of 60 with a line that stars the columns of one residue."""
    pad = max(map(len, a.names)) + 6
    out = ["CLUSTAL W (1.83) multiple sequence alignment", ""]
    star = "".join("*" if len(set(c)) == 1 and c[0] not in "-.~" else " " for c in zip(*a.rows))
    for lo in range(0, len(star), WIDTH):
        out += ["", *(f"{n:<{pad}}{r[lo : lo + WIDTH]}" for n, r in zip(a.names, a.rows)), " " * pad + star[lo : lo + WIDTH]]
    return "\n".join(out) + "\n"


def parse_phylip(text: str) -> Alignment:
    """Interleaved or sequential; names are ten columns wide or end at the first space, whichever fits."""
    head, *lines = [x for x in text.splitlines() if x.strip()]
    n, length = map(int, head.split())
    squeeze = lambda x: "".join(x.split())
    cuts = (lambda x: (x[:10].strip(), x[10:]), lambda x: (x.split()[0], x.split(None, 1)[1] if len(x.split()) > 1 else ""))

    def sequential(cut):
        names, rows, at = [], [], 0
        while at < len(lines):
            name, row = cut(lines[at])
            row, at = squeeze(row), at + 1
            while len(row) < length and at < len(lines):
                row, at = row + squeeze(lines[at]), at + 1
            names.append(name)
            rows.append(row)
        return names, rows

    def interleaved(cut):
        first = [cut(x) for x in lines[:n]]
        rows = [squeeze(r) for _, r in first]
        for i, line in enumerate(lines[n:]):
            rows[i % n] += squeeze(line)
        return [m for m, _ in first], rows

    for read in (interleaved, sequential):
        for cut in cuts:
            names, rows = read(cut)
            if len(rows) == n and all(len(r) == length for r in rows) and all(names):
                return Alignment(names, rows).checked()
    raise ValueError("rows do not match the header")


def write_phylip(a: Alignment) -> str:
    n = len(a.rows[0])
    out = [f" {len(a.rows)} {n}"]
    for lo in range(0, n, WIDTH):
        out += [(f"{m[:10]:<10}" if lo == 0 else " " * 10) + r[lo : lo + WIDTH] for m, r in zip(a.names, a.rows)] + [""]
    return "\n".join(out)


def parse_a2m(text: str) -> Alignment:
    """Upper case and ``-`` are consensus columns, lower case and ``.`` inserts, which are padded; RF marks the
    consensus columns."""
    records = [Record(r.name, r.seq.replace("O", "").replace("o", "")) for r in parse_fasta(text)]
    split = [re.findall(r"([a-z.]*)([A-Z\-*~]?)", r.seq.replace(".", "")) for r in records]
    count = {sum(1 for _, c in s if c) for s in split}
    if len(count) != 1:
        raise ValueError("consensus columns differ in number")
    k = count.pop()
    inserts = [[s[i][0] if i < len(s) else "" for i in range(k + 1)] for s in split]
    widths = [max(len(x[i]) for x in inserts) for i in range(k + 1)]
    rows = ["".join(ins[i].ljust(widths[i], "-").upper() + (s[i][1] if i < k else "") for i in range(k + 1)) for ins, s in zip(inserts, split)]
    rf = "".join("." * widths[i] + ("x" if i < k else "") for i in range(k + 1))
    return Alignment([r.name for r in records], rows, markup=[("gc", None, "RF", rf)]).checked()


def write_a2m(a: Alignment, width: int = WIDTH) -> str:
    """Columns that RF leaves unmarked are inserts: lower case, without gaps. All are consensus without RF."""
    rf = a.column("RF") or "x" * len(a.rows[0])
    row = lambda r: "".join(c.upper() if m not in ".~-" else "" if c in "-.~" else c.lower() for c, m in zip(r, rf))
    return write_fasta([Record(n, row(r)) for n, r in zip(a.names, a.rows)], width)


def parse_psiblast(text: str) -> Alignment:
    """Name and fragment on a line; RF marks the columns with an upper-case residue."""
    a = _interleaved([x for x in text.splitlines() if x.strip()])
    rf = "".join("x" if any(c.isupper() for c in col) else "." for col in zip(*a.rows))
    a.rows = [r.upper() for r in a.rows]
    a.markup = [("gc", None, "RF", rf)]
    return a


def write_psiblast(a: Alignment) -> str:
    pad, n = max(map(len, a.names)), len(a.rows[0])
    rf = a.column("RF") or "x" * n
    rows = ["".join(c.upper() if m not in ".~-" else c.lower() for c, m in zip(r, rf)) for r in a.rows]
    return "\n\n".join("\n".join(f"{m:<{pad}}  {r[lo : lo + WIDTH]}" for m, r in zip(a.names, rows)) for lo in range(0, n, WIDTH)) + "\n"


def parse_selex(text: str) -> Alignment:
    """Blocks of name and row, spaces within a row for gaps; #=RF and #=CS are column markup, #=SS and #=SA
    belong to the row before."""
    a, parts, marks, last = Alignment(), {}, {}, None
    lines = [x.rstrip() for x in text.splitlines()]
    for block in "\n".join("" if x.startswith("#") and not x.startswith("#=") else x for x in lines).split("\n\n"):
        rows = [x for x in block.split("\n") if x.strip()]
        if not rows:
            continue
        starts = [len(x) - len(x.split(None, 1)[1]) if len(x.split(None, 1)) > 1 else len(x) for x in rows]
        left, right = min(starts), max(map(len, rows))
        for x in rows:
            name, body = x.split()[0], x[left:].ljust(right - left).replace(" ", "-")
            if name in ("#=RF", "#=CS"):
                marks.setdefault(("gc", None, {"#=RF": "RF", "#=CS": "SS_cons"}[name]), []).append(body)
            elif name in ("#=SS", "#=SA"):
                marks.setdefault(("gr", last, name[2:]), []).append(body)
            elif not name.startswith("#"):
                parts.setdefault(name, []).append(body)
                last = name
    a.names, a.rows = list(parts), ["".join(p) for p in parts.values()]
    a.markup = [(*k, "".join(v)) for k, v in marks.items()]
    return a.checked()


def write_selex(a: Alignment) -> str:
    pad = max(len(x) for x in [*a.names, "#=RF"])
    out = [f"{t:<{pad}} {v}" for k, _, g, v in a.markup if k == "gc" for t in [{"RF": "#=RF", "SS_cons": "#=CS"}.get(g)] if t]
    for n, r in zip(a.names, a.rows):
        out.append(f"{n:<{pad}} {r}")
        out += [f"{'#=' + g:<{pad}} {v}" for k, m, g, v in a.markup if k == "gr" and m == n and g in ("SS", "SA")]
    return "\n".join(out) + "\n"


SEQUENCES = {"fasta": parse_fasta, "genbank": parse_genbank, "embl": parse_embl}
#: The same of lines, a record at a time.
RECORDS = {"fasta": fasta_records, "genbank": genbank_records, "embl": embl_records}
ALIGNMENTS = {
    "stockholm": parse_stockholm, "afa": lambda t: [parse_afa(t)], "clustal": lambda t: [parse_clustal(t)], "phylip": lambda t: [parse_phylip(t)],
    "a2m": lambda t: [parse_a2m(t)], "psiblast": lambda t: [parse_psiblast(t)], "selex": lambda t: [parse_selex(t)],
}
WRITERS = {
    "fasta": write_fasta, "genbank": write_genbank, "embl": write_embl, "stockholm": write_stockholm, "pfam": lambda a: write_stockholm(a, 0), "afa": write_afa,
    "clustal": write_clustal, "phylip": write_phylip, "a2m": write_a2m, "psiblast": write_psiblast, "selex": write_selex,
}


def parse(text: str, kind: str) -> list[Record] | list[Alignment]:
    if kind in SEQUENCES:
        return SEQUENCES[kind](text)
    if kind in ALIGNMENTS:
        return ALIGNMENTS[kind](text)
    raise ValueError(f"unknown format {kind}")
