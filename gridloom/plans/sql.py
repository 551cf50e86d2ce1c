"""SQL that states what the queries compute, without any of their execution strategy."""

from __future__ import annotations

ORDERS = """
boxes as (select id, x1, x1 + id % 14 x2, y1, y1 + 100 * (ck % 10) y2 from (
  select o_orderkey id, o_custkey ck, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) x1,
    cast(floor(o_totalprice) as bigint) y1 from orders))"""
EVENTS = """
boxes as (select event_id id, x1, x1 + 60 * cast(floor(abs(value)) as bigint) x2, user_id y1, user_id + event_id % 3 y2 from (
  select *, cast(epoch(date_trunc('second', ts)) as bigint) x1 from events))"""
RECTS = """
rects as (select p_partkey rect_id, 9131 + (p_partkey * 29) % 2400 x1, 9131 + (p_partkey * 29) % 2400 + 5 + p_partkey % 40 x2,
  (p_partkey * 4001) % 500000 y1, (p_partkey * 4001) % 500000 + 500 + 10 * (p_partkey % 500) y2 from part)"""
POINTS = "points as (select c_custkey pt_id, 9100 + (c_custkey * 37) % 2500 px, (c_custkey * 7919) % 500000 py from customer)"
RAYS = """
rays as (select s_suppkey ray_id, 9131 + (s_suppkey * 53) % 2400 px, (s_suppkey * 6007) % 500000 py,
  case s_suppkey % 4 when 0 then 1 when 1 then -1 else 0 end dx, case s_suppkey % 4 when 2 then 1 when 3 then -1 else 0 end dy from supplier)"""
BODIES = "bodies as (select s_suppkey id, (s_suppkey * 53) % 997 px, (s_suppkey * 31) % 991 py, 1 + s_suppkey % 7 mass from supplier)"

HIT = "a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2"
IN = "b.x1 <= a.x1 and a.x2 <= b.x2 and b.y1 <= a.y1 and a.y2 <= b.y2"
PAIRS = f"pairs as (select a.id id_a, b.id id_b from boxes a join boxes b on a.id < b.id and {HIT})"
ENDS = "ends as (select id_a id, id_b other from pairs union all select id_b, id_a from pairs)"


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def inside(r: tuple, a: str = "") -> str:
    return f"{r[0]} <= {a}x1 and {a}x2 <= {r[1]} and {r[2]} <= {a}y1 and {a}y2 <= {r[3]}"


def touches(r: tuple, a: str = "") -> str:
    return f"{a}x1 <= {r[1]} and {r[0]} <= {a}x2 and {a}y1 <= {r[3]} and {r[2]} <= {a}y2"


def distance2(px: str, py: str) -> str:
    dx, dy = f"greatest(x1 - {px}, {px} - x2, 0)", f"greatest(y1 - {py}, {py} - y2, 0)"
    return f"({dx} * {dx} + {dy} * {dy})"


def ray_t(px: str, py: str, dx: str, dy: str) -> str:
    """t of the first point of a ray in a box, or null."""

    def slab(o: str, d: str, s: str, e: str) -> tuple[str, str, str]:
        safe = f"(case when {d} = 0 then 1.0::double else {d}::double end)"
        one, two = f"(({s} - {o}) / {safe})", f"(({e} - {o}) / {safe})"
        lo = f"(case when {d} = 0 then '-inf'::double else least({one}, {two}) end)"
        hi = f"(case when {d} = 0 then 'inf'::double else greatest({one}, {two}) end)"
        return f"({d} = 0 and not ({s} <= {o} and {o} <= {e}))", lo, hi

    mx, lx, hx = slab(px, dx, "x1", "x2")
    my, ly, hy = slab(py, dy, "y1", "y2")
    return f"(case when not {mx} and not {my} and greatest({lx}, {ly}, 0.0::double) <= least({hx}, {hy}) then greatest({lx}, {ly}, 0.0::double) end)"


def tree(levels: int | None = None, most: int = 11) -> list[str]:
    """CTEs el (elements with node_id, level, k), dv (dividers) and nodes over boxes, one step for each level."""
    k = str(levels) if levels else "case when n <= 80 then 1 else cast(floor(log2(n // 80)) as bigint) // 2 * 2 + 1 end"
    most = levels or most
    out = [f"cfg as (select {k} k from (select count(*) n from boxes))", "e0 as materialized (select boxes.*, k, 1::bigint node_id, 0 level, k > 1 open from boxes, cfg)"]
    for i in range(most - 1):
        s, e = ("x1", "x2") if i % 2 == 0 else ("y1", "y2")
        out.append(
            f"m{i} as materialized (select node_id, {s} div from (select node_id, {s}, row_number() over (partition by node_id order by {s}) rn, "
            f"count(*) over (partition by node_id) n from e{i} where open) where rn = n // 2 + 1)"
        )
        out.append(
            f"e{i + 1} as materialized (select id, x1, x2, y1, y2, k, case go when 1 then node_id * 2 when 2 then node_id * 2 + 1 else node_id end node_id, "
            f"case when go > 0 then {i + 1} else level end level, go > 0 and k > {i + 2} open from (select e.*, case when not open then 0 when {e} < div then 1 when {s} > div then 2 else 0 end go "
            f"from e{i} e left join m{i} m using (node_id)))"
        )
    out.append(f"el as materialized (select id, x1, x2, y1, y2, k, node_id, level from e{most - 1})")
    out.append("dv as materialized (" + (" union all ".join(f"select * from m{i}" for i in range(most - 1)) or "select 1::bigint node_id, 0::bigint div where false") + ")")
    out.append("ids as (select i node_id, cast(floor(log2(i + 0.5)) as integer) level from (select unnest(range(1, 1 << k)) i from cfg))")
    out.append("own as (select node_id, level, min(case when level % 2 = 0 then x1 else y1 end) cont_start, max(case when level % 2 = 0 then x2 else y2 end) cont_end, count(*) n from el group by all)")
    out.append("under as (select node_id >> s node_id, sum(n) n from (select node_id, n, unnest(range(0, level + 1)) s from own) group by 1)")
    out.append("fewest as (select ids.node_id // 2 node_id, min(coalesce(n, 0)) n from ids left join under using (node_id) where ids.node_id > 1 group by 1)")
    out.append(
        "nodes as materialized (select ids.node_id, ids.level, cast(ids.level % 2 as integer) axis, div, coalesce(cont_start, 0) cont_start, coalesce(cont_end, 0) cont_end, "
        "cast(coalesce(own.n, 0) as bigint) n, cast(coalesce(fewest.n, 0) as bigint) min_elem from ids left join own using (node_id) left join dv using (node_id) left join fewest using (node_id))"
    )
    return out


def frontiers(near: int, half: int) -> list[str]:
    """CTEs acts (a, p_node, p, q_node, q and both places and masses) over bodies and the tree's el, dv: who meets whom by frontiers."""
    out = [
        "ups as (select id, level, node_id, node_id >> s up from (select el.*, unnest(range(0, level + 1)) s from el))",
        "mass as (select up d, cast(floor(log2(up + 0.5)) as bigint) ld, sum(mass)::double m, sum(mass * px)::double / sum(mass) x, sum(mass * py)::double / sum(mass) y from ups join bodies using (id) group by 1)",
        "splits as (select node_id a, cast(floor(log2(node_id + 0.5)) as bigint) la, div from dv)",
        "met as (select a, d, ld, 1 + (d >> greatest(ld - la - 1, 0)) % 2 side, abs(case la % 2 when 0 then x else y end - div) dist, m, x, y from splits join mass on ld > la and d >> greatest(ld - la, 0) = a)",
    ]
    for name, bound in (("whole", near), ("half", half)):
        out.append(f"{name}_reached as (select * from met where not exists (select 1 from met o where o.a = met.a and o.ld < met.ld and met.d >> greatest(met.ld - o.ld, 0) = o.d and o.dist >= {bound}))")
        out.append(
            f"{name} as (select a, side, true is_node, d k, x, y, m from {name}_reached where dist >= {bound} "
            f"union all select a, side, false, id, px, py, mass from {name}_reached join el on node_id = d join bodies using (id) where dist < {bound})"
        )
    out.append("anchors as (select node_id a, 0 side, false is_node, id k, px::double x, py::double y, mass::double m from el join bodies using (id))")
    out.append("one_way as (select p.is_node p_node, p.k p, p.x px, p.y py, p.m pm, q.is_node q_node, q.k q, q.x qx, q.y qy, q.m qm from (select p, q from anchors p join whole q using (a) union all select p, q from half p join half q using (a) where p.side = 1 and q.side = 2 union all select p, q from anchors p join anchors q using (a) where p.k < q.k))")
    out.append("acts as (select p_node is_node, p k, qx - px dx, qy - py dy, qm m from one_way union all select q_node, q, px - qx, py - qy, pm from one_way)")
    return out
