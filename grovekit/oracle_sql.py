"""DuckDB SQL of models that take several steps, written out step by step: trees by level, boosting by stage, k-means by
iteration. It shares nothing with the operators but the definitions."""

from __future__ import annotations


def _long(rows: str, features: int, rest: str) -> str:
    return " union all ".join(f"select node, {a} as attr, f{a} as value, {rest} from {rows}" for a in range(features))


def _children(i: int, p: str = "") -> str:
    """The id of a level's first new node: the root and two for each split before."""
    return " + ".join(["1"] + [f"2 * (select count(*) from {p}b{j})" for j in range(i)])


def classification_ctes(levels: int, features: list[str], label: str, table: str) -> list[str]:
    """r0, ... the rows by node of each level (as counts), b0, ... the splits: node, attr, threshold, k."""
    d = len(features)
    columns = ", ".join(f"f{a}" for a in range(d))
    out = ["r0 as materialized (select 0 as node, " + ", ".join(f"{f} as f{a}" for a, f in enumerate(features)) + f", {label} as label, count(*) as n from {table} where {label} is not null group by all)"]
    for i in range(levels):
        value = "case attr " + " ".join(f"when {a} then f{a}" for a in range(d)) + " end"
        out += [
            f"h{i} as materialized (select node, attr, value, label, cast(sum(n) as bigint) as n from ({_long(f'r{i}', d, 'label, n')}) group by all)",
            f"g{i} as (select v.node, v.attr, v.value, t.c, coalesce(sum(h.n) over (partition by v.node, v.attr, t.label order by v.value rows between unbounded preceding and 1 preceding), 0) as s "
            f"from (select distinct node, attr, value from h{i}) v join (select node, attr, label, sum(n) as c from h{i} group by all) t on t.node = v.node and t.attr = v.attr "
            f"left join h{i} h on h.node = v.node and h.attr = v.attr and h.value = v.value and h.label = t.label)",
            f"k{i} as (select node, attr, value as threshold, sum(c)::double as n, sum(s)::double as l, sum(c::double * c) as cc, sum(s::double * s) as ss, sum((c - s)::double * (c - s)) as rr from g{i} group by all)",
            f"q{i} as (select node, attr, threshold, 1 - cc / (n * n) - l / n * (1 - ss / (l * l)) - (1 - l / n) * (1 - rr / ((n - l) * (n - l))) as gain from k{i} where l > 0 and l < n)",
            f"b{i} as materialized (select node, attr, threshold, row_number() over (order by node) as k from (select *, row_number() over (partition by node order by round(gain, 9) desc, attr, threshold) as place from q{i}) where place = 1 and gain > 1e-12)",
            f"r{i + 1} as materialized (select {_children(i)} + 2 * (k - 1) + case when {value} < threshold then 0 else 1 end as node, {columns}, label, n from r{i} join b{i} using (node))",
        ]
    return out


def classification_nodes(levels: int, features: list[str], label: str, table: str) -> str:
    out = classification_ctes(levels, features, label, table)
    rows = " union all ".join(f"select node, label, n from r{i}" for i in range(levels + 1))
    splits = " union all ".join(f"select node, attr, threshold from b{i}" for i in range(levels))
    out.append(f"m as (select node, label, row_number() over (partition by node order by sum(n) desc, label) as place from ({rows}) group by node, label)")
    return f"with {', '.join(out)} select cast(node as int) as node_id, s.attr is null as is_leaf, cast(s.attr as int) as feature, s.threshold, m.label from m left join ({splits}) s using (node) where place = 1"


def _median(rows: str, keys: str) -> str:
    """keys, median, total: the element of rank floor(total / 2) of (y, n) counts."""
    summed = f"select {keys}, y, sum(n) as n from {rows} group by all"
    ranked = f"select {keys}, y, sum(n) over (partition by {keys} order by y) as upto, sum(n) over (partition by {keys}) as total from ({summed})"
    return f"select {keys}, min(y) filter (2 * upto > total) as median, max(total) as total from ({ranked}) group by {keys}"


def regression_ctes(levels: int, source: str, features: int, p: str = "") -> list[str]:
    """The same of subset rules. source has f0, f1, ..., done, y, n; done is carried along. pr0, ... have the rows by node,
    pb0, ... the splits, po0, ... the values' places: a value goes left if its place is at most the split's cut."""
    columns = ", ".join(f"f{a}" for a in range(features))
    out = [f"{p}r0 as materialized (select 0 as node, {columns}, done, y, n from {source})"]
    for i in range(levels):
        x, o, b = f"{p}x{i}", f"{p}o{i}", f"{p}b{i}"
        value = "case b.attr " + " ".join(f"when {a} then r.f{a}" for a in range(features)) + " end"
        out += [
            f"{x} as materialized (select node, attr, value, y, cast(sum(n) as bigint) as n from ({_long(f'{p}r{i}', features, 'y, n')}) group by all)",
            f"{o} as materialized (select node, attr, value, row_number() over (partition by node, attr order by median, value) as place, count(*) over (partition by node, attr) as places from ({_median(x, 'node, attr, value')}))",
            f"{p}s{i} as materialized (select x.node, x.attr, cut, place <= cut as l, y, sum(n) as n from {x} x join {o} o on o.node = x.node and o.attr = x.attr and o.value = x.value, unnest(range(1, places)) t(cut) group by all)",
            f"{p}w{i} as (select s.node, s.attr, s.cut, s.l, total, sum(n * abs(y - median)) as loss from {p}s{i} s join ({_median(f'{p}s{i}', 'node, attr, cut, l')}) w on w.node = s.node and w.attr = s.attr and w.cut = s.cut and w.l = s.l group by all)",
            f"{p}c{i} as (select node, attr, cut, sum(loss * total) / sum(total) as loss from {p}w{i} group by all)",
            f"{b} as materialized (select node, attr, cut, row_number() over (order by node) as k from (select *, row_number() over (partition by node order by round(loss, 9), attr, cut) as best from {p}c{i}) where best = 1)",
            f"{p}r{i + 1} as materialized (select {_children(i, p)} + 2 * (k - 1) + case when o.place <= b.cut then 0 else 1 end as node, {columns}, done, y, n from {p}r{i} r join {b} b on b.node = r.node join {o} o on o.node = r.node and o.attr = b.attr and o.value = {value})",
        ]
    return out


def regression_nodes(levels: int, ctes: list[str], source: str, features: int) -> str:
    out = [*ctes, *regression_ctes(levels, source, features)]
    rows = " union all ".join(f"select node, y, n from r{i}" for i in range(levels + 1))
    splits = " union all ".join(
        f"select b.node, b.attr, string_agg(o.value, ',' order by o.value) as subset from b{i} b join o{i} o on o.node = b.node and o.attr = b.attr and o.place <= b.cut group by all" for i in range(levels)
    )
    out.append(f"m as ({_median(f'({rows})', 'node')})")
    return f"with {', '.join(out)} select cast(node as int) as node_id, s.attr is null as is_leaf, cast(s.attr as int) as feature, s.subset, m.median as label from m left join ({splits}) s using (node)"


def boosted_counts(stages: int, rate: float, ctes: list[str], source: str, features: int) -> str:
    """prediction, n of boosted trees of one level that split at each stage."""
    out, columns = list(ctes), ", ".join(f"f{a}" for a in range(features))
    for k in range(stages):
        p = f"t{k}"
        out += regression_ctes(1, source, features, p)
        out.append(f"u{k} as materialized (select {columns}, done + {rate}::double * median as done, y - {rate}::double * median as y, n from {p}r1 join ({_median(f'{p}r1', 'node')}) using (node))")
        source = f"u{k}"
    return f"with {', '.join(out)} select done as prediction, cast(sum(n) as bigint) as n from {source} group by 1"


def _draw(seed: int, j: int) -> str:
    return f"(cast('0x' || substr(md5(id || ':{seed}:{j}'), 1, 13) as bigint) + 0.5::double) / {float(1 << 52)!r}::double"


def plus_plus_ctes(k: int, seed: int, table: str, row_id: str, vector: str) -> list[str]:
    """d0: the points; start: cluster, c."""
    out = [f"d0 as materialized (select {row_id} as id, list_transform({vector}, lambda x: x::double) as v, 1.0::double as d from {table} where {vector} is not null)"]
    for j in range(k):
        out.append(f"p{j} as materialized (select v as c from d{j} order by case when d > 0 then -ln({_draw(seed, j)}) / d else 'infinity'::double end, id limit 1)")
        if j + 1 < k:
            near = "list_distance(v, c) ** 2" if j == 0 else "least(d, list_distance(v, c) ** 2)"
            out.append(f"d{j + 1} as materialized (select id, v, {near} as d from d{j}, p{j})")
    out.append("start as materialized (" + " union all ".join(f"select {j} as cluster, c from p{j}" for j in range(k)) + ")")
    return out


def lloyd_ctes(iterations: int, dims: int) -> list[str]:
    """a1, c1, ...: id, v, cluster and cluster, c of each update after start, of the points d0."""
    out, before = [], "start"
    for i in range(1, iterations + 1):
        out += [
            nearest_cte(f"a{i}", before),
            f"e{i} as (select cluster, j, avg(x) as x from (select cluster, unnest(v) as x, unnest(range({dims})) as j from a{i}) group by all)",
            f"c{i} as materialized (select s.cluster, coalesce(e.c, list_transform(range({dims}), lambda x: 0.0::double)) as c from start s left join (select cluster, list(x order by j) as c from e{i} group by 1) e on e.cluster = s.cluster)",
        ]
        before = f"c{i}"
    return out


def nearest_cte(name: str, centroids: str) -> str:
    return f"{name} as materialized (select id, any_value(v) as v, arg_min(cluster, struct_pack(d := list_distance(v, c) ** 2, k := cluster)) as cluster from d0, {centroids} group by id)"
