"""Row-at-a-time statement of the loading rules, to test the vector form against."""

import re


def _fields(line):
    """(columns, whether a quoted column is not closed properly)."""
    out, i, n, bad = [], 0, len(line), False
    while True:
        if i < n and line[i] == '"':
            j, v, closed = i + 1, "", False
            while j < n:
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        v += '"'
                        j += 2
                        continue
                    closed = True
                    j += 1
                    break
                v += line[j]
                j += 1
            if not closed or (j < n and line[j] != "\t"):
                return out, True
            out.append(v)
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            out.append(line[i:j])
        if j >= n:
            return out, bad
        i = j + 1


def reason(fmt, raw, width):
    if fmt == "fastq":
        lines = [x[:-1] if x.endswith("\r") else x for x in raw.split("\n")]
        if len(lines) != 4 or lines[0][:1] != "@" or lines[2][:1] != "+":
            return "layout"
        if not lines[1] or set(lines[1].upper()) - set("ACGTRYSWKMBDHVN"):
            return "seq"
        if len(lines[1]) != len(lines[3]) or any(not "!" <= c <= "~" for c in lines[3]):
            return "qual"
        return None
    line = raw[:-1] if raw.endswith("\r") else raw
    cols, bad = _fields(line)
    if bad:
        return "quoting"
    if fmt == "gtf" and len(cols) >= 9 and line.split("\t")[8].count('"') % 2:
        return "quoting"
    if len(cols) != width:
        return "layout"
    for s, e in {"bed": [(1, 2)], "bedpe": [(1, 2), (4, 5)]}.get(fmt, [(3, 4)]):
        if e >= len(cols) or any(not re.fullmatch("[0-9]+", cols[k]) or int(cols[k]) > 2**63 - 1 for k in (s, e)) or int(cols[s]) > int(cols[e]):
            return "coords"
    if fmt in ("gff3", "gtf") and cols[7] not in (".", "0", "1", "2"):
        return "phase"
    return None


def rejects(rows):
    """[(raw_id, reason)] of rows (raw_id, file, line, fmt, raw)."""
    first = {}
    kept = []
    for r in sorted(rows, key=lambda r: (r[1] or "", r[2])):
        if r[4] is None or (r[3] != "fastq" and (r[4] in ("", "\r") or r[4][0] == "#")):
            continue
        kept.append(r)
        if r[3] in ("bed", "bedpe"):
            line = r[4][:-1] if r[4].endswith("\r") else r[4]
            first.setdefault((r[3], r[1]), len(_fields(line)[0]) if not _fields(line)[1] else None)
    out = []
    for r in kept:
        why = reason(r[3], r[4], first.get((r[3], r[1]), 9))
        if why:
            out.append((r[0], why))
    return out
