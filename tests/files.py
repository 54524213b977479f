"""Small BAM and VCF files after the public specifications."""

import struct
import zlib


def _block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = len(body) + 25
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, refs, reads, per_block=2, index=False):
    """reads: (name, flag, ref, start0, mapq, cigar, seq, qual or None), sorted."""
    text = b"@HD\tVN:1.6\tSO:coordinate\n"
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, size in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    out, linear = _block(head), [dict() for _ in refs]
    rows = []
    for name, flag, ref, start, mapq, cigar, seq, qual in reads:
        ops, num = [], ""
        for c in cigar:
            if c.isdigit():
                num += c
            else:
                ops.append(int(num) << 4 | "MIDNSHP=X".index(c))
                num = ""
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, start, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (bytes(qual) if qual is not None else b"\xff" * len(seq))
        span = sum(o >> 4 for o in ops if "MIDNSHP=X"[o & 15] in "MDN=X")
        rows.append((ref, start, max(1, span), struct.pack("<i", len(body)) + body))
    for k in range(0, len(rows), per_block):
        data, start = b"", len(out)
        for ref, pos, span, r in rows[k : k + per_block]:
            for w in range(pos >> 14, (pos + span - 1 >> 14) + 1):
                linear[ref].setdefault(w, start << 16 | len(data))
            data += r
        out += _block(data)
    out += bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    open(path, "wb").write(out)
    if index:
        bai = b"BAI\x01" + struct.pack("<i", len(refs))
        for own in linear:
            n = max(own, default=-1) + 1
            bai += struct.pack("<ii", 0, n) + struct.pack(f"<{n}Q", *(own.get(w, 0) for w in range(n)))
        open(path + ".bai", "wb").write(bai)


def write_vcf(path, samples, records, formats=("GT",), chroms=("chr1",)):
    """records: (chrom, pos, ref, alt, info, format, [calls])."""
    lines = ["##fileformat=VCFv4.2", *(f'##FORMAT=<ID={f},Number=1,Type=String,Description="x">' for f in formats), *(f"##contig=<ID={c},length=1000000>" for c in chroms)]
    lines.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    lines += ["\t".join([c, str(p), ".", r, a, ".", "PASS", info, f, *calls]) for c, p, r, a, info, f, calls in records]
    open(path, "w").write("\n".join(lines) + "\n")
