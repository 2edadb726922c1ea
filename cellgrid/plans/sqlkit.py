"""Text helpers for writing the DuckDB oracles."""

from __future__ import annotations


def line_sums(src: str) -> str:
    """Checksums of a voxel table per image line."""
    return f"""select section, channel, z, y, count(*) as n, sum(v) as s, sum(v*(x+1)) as sx
        from ({src}) group by all"""


def reflect(e: str, n: str) -> str:
    return f"(case when {e}<0 then -({e})-1 when {e}>={n} then 2*{n}-({e})-1 else {e} end)"


def nearest(e: str, n: str) -> str:
    return f"least(greatest({e},0),{n}-1)"


def weighted(src: str, axis: str, weights: list[float], cols: dict[str, str], edge=nearest, n: str | None = None) -> str:
    """Select-list text of one weighted pass; ``cols`` maps output name -> input column."""
    half = len(weights) // 2
    vals = ",".join(f"({k - half},{w!r}::double)" for k, w in enumerate(weights))
    same = " and ".join(f"b.{a}=a.{a}" for a in ("section", "channel", "z", "y", "x") if a != axis)
    size = n or f"a.n_{axis}"
    outs = ", ".join(f"sum(k.w*b.{c}) as {o}" for o, c in cols.items())
    return f"""with tgt as materialized (select a.section, a.channel, a.z, a.y, a.x, k.w, ({edge(f'(a.{axis}+k.o)', size)})::int as j
          from {src} a, (values {vals}) k(o,w))
        select a.section, a.channel, a.z, a.y, a.x, {outs.replace('k.w*', 'a.w*')} from tgt a join {src} b
        on {same} and b.{axis} = a.j group by a.section, a.channel, a.z, a.y, a.x"""


def hash32(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::bigint"
