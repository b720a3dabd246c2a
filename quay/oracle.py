"""DuckDB SQL that says what the registered queries say, written on its own from the same rules and fixed values."""

from __future__ import annotations

import json
import re

from quay.functions import fixed
from quay.sources import appdb


def values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def glob_regex(glob: str) -> str | None:
    """A glob as a regular expression, character by character; None if it is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "\\":
            if i == len(glob):
                return None
            out, i = out + re.escape(glob[i]), i + 1
        elif c == "[":
            end = i + 1 if glob[i : i + 1] == "^" else i
            start = end
            while end < len(glob) and glob[end] != "]":
                end += 2 if glob[end] == "\\" else 1
            if end >= len(glob) or end == start:
                return None
            out += "[" + ("^" if start > i else "") + glob[start:end] + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def _lists() -> dict[str, str]:
    from quay import catalog

    text = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    return {"folders": text(catalog.FOLDERS), "endings": text(catalog.ENDINGS)}


def _files() -> str:
    x = _lists()
    return f"""files AS (SELECT doc_id AS seq, '/home/u/' || ({x['folders']})[doc_id % 8 + 1] || '/f' || doc_id || ({x['endings']})[doc_id % 11 + 1] AS path,
    strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha256, coalesce(text, '') AS text FROM documents)"""


def _scan() -> str:
    exts = values(sorted(fixed.class_table().items()))
    names = values([(n,) for n in fixed.TEXT_NAMES])
    rules = values([(d.lower(), d) for d, _ in fixed.rules()])
    return rf"""{_files()},
exts AS (SELECT * FROM {exts} AS t(ext, class)), known AS (SELECT * FROM {names} AS t(name)),
rules AS (SELECT * FROM {rules} AS t(seg, dir)),
named AS (SELECT seq, path, size, sha256, lower(regexp_extract(path, '([^/\\]*)$', 1)) AS name FROM files),
cut AS (SELECT *, starts_with(name, '.') AND instr(name[2:], '.') = 0 AS hidden,
        CASE WHEN contains(name, '.') THEN regexp_extract(name, '([^.]*)$', 1) END AS e1, regexp_extract(name, '^(.*)\.[^.]*$', 1) AS rest FROM named),
two AS (SELECT *, CASE WHEN NOT hidden AND e1 <> '' AND contains(rest, '.') THEN regexp_extract(rest, '([^.]*)$', 1) END AS e2 FROM cut),
classed AS (SELECT two.*, CASE WHEN hidden THEN coalesce(a.class, 'text') ELSE coalesce(a.class, CASE WHEN known.name IS NOT NULL THEN 'text' END, b.class, 'unknown') END AS class
        FROM two LEFT JOIN exts a ON a.ext = nullif(two.e1, '') LEFT JOIN exts b ON b.ext = two.e2 LEFT JOIN known ON known.name = two.name AND NOT two.hidden),
segs AS (SELECT seq, unnest(string_split(path[9:], '/')[:-2]) AS seg, unnest(range(len(string_split(path[9:], '/')) - 1)) AS pos FROM files),
ruled AS (SELECT seq, arg_min(dir, pos) AS rule FROM segs JOIN rules ON rules.seg = lower(segs.seg) GROUP BY seq),
sec AS (SELECT seq, coalesce(n.why, x.why, CASE WHEN name = '.env' OR starts_with(name, '.env.') THEN '{fixed.SECRET_ENV}' END, s.why) AS secret FROM cut
        LEFT JOIN {values(sorted(fixed.SECRET_NAMES.items()))} AS n(k, why) ON n.k = cut.name LEFT JOIN {values(sorted(fixed.SECRET_EXTS.items()))} AS x(k, why) ON x.k = cut.e1
        LEFT JOIN (SELECT seq, arg_min(why, pos) AS why FROM (SELECT seq, unnest(string_split(path, '/')) AS seg, unnest(range(len(string_split(path, '/')))) AS pos FROM files)
                   JOIN {values(sorted(fixed.SECRET_DIRS.items()))} AS d(k, why) ON d.k = lower(seg) GROUP BY seq) AS s USING (seq)),
scan AS (SELECT classed.seq, path, size, sha256, class, rule, secret FROM classed LEFT JOIN ruled USING (seq) LEFT JOIN sec USING (seq)),
buckets AS (SELECT class, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM scan WHERE rule IS NULL AND secret IS NULL GROUP BY class)"""


def _human(n: str) -> str:
    out = f"CASE WHEN {n} < 1024 THEN {n} || ' B'"
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        v = f"({n} / {float(1024**i)})"
        out += f" WHEN {n} < {1024 ** (i + 1)} THEN CASE WHEN {v} >= 100 THEN printf('%.0f', {v}) ELSE replace(printf('%.1f', {v}), '.', ',') END || ' {unit}'"
    return out + " END"


def _package(block: int) -> str:
    return f"""{_scan()},
firsts AS (SELECT sha256, size, min(seq) AS first FROM files WHERE size > 0 GROUP BY sha256, size),
mine AS (SELECT classed.seq, classed.path, classed.size, classed.sha256, class, coalesce(first < classed.seq, false) AS dup, coalesce(first, classed.seq) AS original, class IN ('text', 'binary') AS compressible
         FROM classed LEFT JOIN firsts ON firsts.sha256 = classed.sha256 AND firsts.size = classed.size),
places AS (SELECT seq, size, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM mine WHERE compressible AND NOT dup AND size > 0),
sol AS (SELECT seq, size, pos, unnest(range(pos // {block}, (pos + size - 1) // {block} + 1)) AS solid FROM places),
solid AS (SELECT seq, solid, greatest(pos, solid * {block}) - solid * {block} AS off, least(pos + size, (solid + 1) * {block}) - greatest(pos, solid * {block}) AS len FROM sol),
sto AS (SELECT seq, size, unnest(range(0, (size - 1) // {block} + 1)) AS k FROM mine WHERE NOT compressible AND NOT dup AND size > 0),
stored AS (SELECT seq, k, least({block}, size - k * {block}) AS len FROM sto),
every AS (SELECT 'solid' AS kind, CASE WHEN sum(len) < {block} THEN (SELECT max(seq) + 1 FROM files) ELSE max(seq) END AS at_seq, solid AS k, NULL::BIGINT AS file, CAST(sum(len) AS BIGINT) AS raw FROM solid GROUP BY solid
          UNION ALL SELECT 'stored', seq, k, seq, len FROM stored),
blocks AS (SELECT *, row_number() OVER (ORDER BY at_seq, kind, k) - 1 AS block_id FROM every),
own AS (SELECT s.seq, b.block_id, off, len FROM solid s JOIN blocks b ON b.kind = 'solid' AND b.k = s.solid UNION ALL SELECT s.seq, b.block_id, 0, len FROM stored s JOIN blocks b ON b.file = s.seq AND b.k = s.k),
parts AS (SELECT m.seq, block_id, off, len, row_number() OVER (PARTITION BY m.seq ORDER BY block_id) - 1 AS n FROM mine m JOIN own ON own.seq = m.original WHERE m.size > 0)"""


def _volumes(block: int, volume: int, reserve: int) -> str:
    h, b = fixed.VOLUME_HEAD, fixed.BLOCK_HEAD
    return f"""RECURSIVE {_package(block)},
prevs AS (SELECT block_id, list(prev) AS prevs FROM (SELECT seq, block_id, coalesce(lag(block_id) OVER (PARTITION BY seq ORDER BY block_id), -1) AS prev FROM (SELECT DISTINCT seq, block_id FROM parts)) GROUP BY block_id),
rows AS MATERIALIZED (SELECT block_id, raw, prevs FROM blocks JOIN prevs USING (block_id)),
fold AS (SELECT 0::BIGINT AS block_id, 1 AS volume, {h}::BIGINT AS pos, {h}::BIGINT + {b} + raw AS next, 0::BIGINT AS first, 1::BIGINT AS n, len(prevs)::BIGINT AS touched FROM rows WHERE block_id = 0
  UNION ALL SELECT r.block_id, CASE WHEN fit THEN volume ELSE volume + 1 END, CASE WHEN fit THEN next ELSE {h} END, CASE WHEN fit THEN next ELSE {h} END + {b} + raw, CASE WHEN fit THEN first ELSE r.block_id END, CASE WHEN fit THEN n + 1 ELSE 1 END,
    CASE WHEN fit THEN touched + len(list_filter(prevs, lambda p: p < first)) ELSE len(prevs) END
  FROM (SELECT rows.*, f.volume, f.next, f.first, f.n, f.touched, f.next + {b} + rows.raw + f.touched * {fixed.PER_ENTRY} + f.n * {fixed.PER_BLOCK} + {reserve} <= {volume} AS fit FROM fold f JOIN rows ON rows.block_id = f.block_id + 1) r),
located AS (SELECT block_id, volume, pos FROM fold)"""


def _roots() -> str:
    from quay import catalog

    return f"""{_files()}, roots AS (SELECT * FROM {values(catalog.ROOTS)} AS t(root, root_path)),
best AS (SELECT seq, arg_max(root, length(root_path)) AS root, arg_max(root_path, length(root_path)) AS up FROM files JOIN roots ON path = root_path OR starts_with(path, root_path || '/') GROUP BY seq),
split AS (SELECT seq, size, sha256, coalesce(root, 'other') AS root, CASE WHEN up IS NULL THEN path[2:] WHEN path = up THEN '.' ELSE path[length(up) + 2:] END AS rel FROM files LEFT JOIN best USING (seq))"""


def _sightings() -> str:
    from quay import catalog

    via, package, title = (str(list(x)) for x in ([v for v, _ in catalog.PACKAGES], [p for _, p in catalog.PACKAGES], catalog.TITLES))
    entries = [json.loads(x) for x in appdb.SAMPLE]
    pkgs = [(e["id"], m, (p.split(" ")[0] if m == "snap" else p).lower()) for e in entries for os in ("windows", "linux") for m, ps in e.get(os, {}).items() if m not in ("paths", "registry") for p in ps]
    titles = [(e["id"], n.lower()) for e in entries for n in e.get("windows", {}).get("registry", [])]
    return f"""seen AS (SELECT user_id AS machine, event_id AS seq, event_id % 15 AS k, event_id % 15 >= 8 AS t, version, desktop FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '1.' || event_id END AS version, event_id % 2 = 0 AS desktop FROM events)),
sight AS (SELECT machine, seq, version, desktop, CASE WHEN t THEN 'registry' ELSE ({via})[k + 1] END AS via, CASE WHEN t THEN ({title})[k - 7] ELSE ({package})[k + 1] END AS package FROM seen),
pkgs AS (SELECT * FROM {values(pkgs)} AS x(app_id, manager, key)), titles AS (SELECT * FROM {values(titles)} AS x(app_id, name)),
tried AS (SELECT seq, unnest(CASE via WHEN 'dnf' THEN ['dnf', 'zypper'] WHEN 'zypper' THEN ['dnf', 'zypper'] WHEN 'pacman' THEN ['pacman', 'aur'] ELSE [via, via] END) AS manager, unnest([package, CASE WHEN via = 'scoop' AND contains(package, '/') THEN regexp_extract(package, '^[^/]*/(.*)$', 1) ELSE package END]) AS asked, unnest([0, 1]) AS prio FROM sight WHERE via <> 'registry'),
byname AS (SELECT seq, arg_max(app_id, length(name)) AS app_id FROM sight JOIN titles ON lower(package) = name OR starts_with(lower(package), name || ' ') OR starts_with(lower(package), name || '(') WHERE via = 'registry' GROUP BY seq),
bypkg AS (SELECT seq, arg_min(app_id, prio) AS app_id FROM tried JOIN pkgs ON pkgs.manager = tried.manager AND pkgs.key = lower(CASE WHEN tried.manager = 'snap' THEN string_split(asked, ' ')[1] ELSE asked END) GROUP BY seq),
matched AS (SELECT sight.*, coalesce(bypkg.app_id, byname.app_id) AS app_id FROM sight LEFT JOIN bypkg USING (seq) LEFT JOIN byname USING (seq))"""


def _manifest() -> str:
    entries = [json.loads(x) for x in appdb.SAMPLE]
    apps = [(e["id"], "linux" in e, e["config"]["portability"]) for e in entries]
    ids = [(e["id"], m, i, p) for e in entries for m in ("pacman", "apt") for i, p in enumerate(e.get("linux", {}).get(m, []))]
    able = [(e["id"], ",".join(m for m, os in fixed.MANAGERS.items() if os == "linux" and e.get("linux", {}).get(m))) for e in entries if "linux" in e]
    equal = [(e["id"], i, q) for e in entries for i, q in enumerate(e.get("equivalents", []))]
    spots = [(e["id"], os, k, p) for e in entries for os in ("windows", "linux") for k, p in e.get(os, {}).get("paths", {}).items()]
    return f"""{_sightings()},
manifest AS (SELECT app_id, min(seq) AS pos FROM matched WHERE app_id IS NOT NULL GROUP BY app_id UNION ALL SELECT 'ghost', -1),
apps AS (SELECT * FROM {values(apps)} AS t(app_id, is_on, portability)), spots AS (SELECT * FROM {values(spots)} AS t(app_id, os, key, path)),
here AS (SELECT * FROM (VALUES ('rook', 'pacman'), ('kestrel', 'flatpak')) AS t(app_id, via)),
pick AS (SELECT app_id, arg_min(manager, r) AS manager, arg_min(package, r) AS package FROM (SELECT *, CASE manager WHEN 'pacman' THEN 0 ELSE 100 END + ord AS r FROM {values(ids)} AS t(app_id, manager, ord, package)) GROUP BY app_id),
able AS (SELECT * FROM {values(able)} AS t(app_id, needs)),
eq AS (SELECT e.app_id, arg_min(e.q, ord) AS q FROM {values(equal)} AS e(app_id, ord, q) JOIN apps ON apps.app_id = e.q AND is_on LEFT JOIN here ON here.app_id = e.q LEFT JOIN pick ON pick.app_id = e.q WHERE here.via IS NOT NULL OR pick.manager IS NOT NULL GROUP BY e.app_id),
plan AS (SELECT m.app_id, m.pos, CASE WHEN apps.app_id IS NULL THEN 'missing' WHEN here.via IS NOT NULL THEN 'present' WHEN is_on AND pick.manager IS NOT NULL THEN 'install' WHEN is_on THEN 'no_source' WHEN hq.via IS NOT NULL THEN 'present' WHEN eq.q IS NOT NULL THEN 'install' ELSE 'missing' END AS bucket,
  apps.app_id IS NOT NULL AND here.via IS NULL AND NOT coalesce(is_on, false) AND eq.q IS NOT NULL AS stands_in, eq.q, here.via AS own_via, hq.via AS q_via, pick.manager AS own_m, pq.manager AS q_m, pick.package AS own_p, pq.package AS q_p, needs
  FROM manifest m LEFT JOIN apps USING (app_id) LEFT JOIN here USING (app_id) LEFT JOIN pick USING (app_id) LEFT JOIN able USING (app_id) LEFT JOIN eq USING (app_id) LEFT JOIN here hq ON hq.app_id = eq.q LEFT JOIN pick pq ON pq.app_id = eq.q)"""


def _windows(column: str) -> str:
    """A path with what Windows refuses replaced, segment by segment: each as it is (s) and replaced (w)."""
    reserved = ", ".join(f"'{n}'" for n in fixed.RESERVED_NAMES)
    segment = f"""CASE WHEN x.s IN ('', '.') THEN x.s WHEN x.s = '..' THEN '_..' WHEN lower(CASE WHEN instr(x.w, '.') > 1 THEN string_split(x.w, '.')[1] ELSE x.w END) IN ({reserved}) THEN '_' || x.w ELSE x.w END"""
    pairs = rf"""list_transform(string_split({column}, '/'), lambda s: {{'s': s, 'w': coalesce(nullif(rtrim(regexp_replace(s, '[\x00-\x1f<>:"\\|?*]', '_', 'g'), '. '), ''), '_')}})"""
    return f"array_to_string(list_transform({pairs}, lambda x: {segment}), '/')"


def _entries() -> str:
    names = ["Report: final?.docx", "report: FINAL?.docx", "con.txt", "notes. ", "a<b>|c.md"]
    return f"""{_files()}, entries AS (SELECT DISTINCT (['documents', 'pictures', 'downloads', 'other'])[seq % 4 + 1] AS root,
        'd' || (seq // 40) || '/x' || (seq % 3) || '/' || ({names})[seq % 5 + 1] || CASE WHEN seq % 2 = 0 THEN '' ELSE '~' END || '/' || (seq // 20) || CASE WHEN seq % 20 < 10 THEN '.Txt' ELSE '.txt' END AS path, size FROM files)"""


def _renamed(name: str, k: str) -> str:
    """A name whose ending has four characters with the suffixes of the k-th that wants it."""
    return f"left({name}, length({name}) - 4) || array_to_string(list_transform(range(2, {k} + 1), lambda i: ' (' || i || ')'), '') || right({name}, 4)"


def _restore() -> str:
    return f"""{_entries()}, a AS (SELECT *, CASE WHEN root = 'downloads' THEN 'other' ELSE root END AS to_root, CASE WHEN root = 'downloads' THEN root || '/' || path ELSE path END AS clean FROM entries),
    r AS (SELECT *, row_number() OVER (PARTITION BY to_root, clean ORDER BY root, path) AS k FROM a),
    n AS (SELECT *, CASE to_root WHEN 'documents' THEN '/home/u/Documents' WHEN 'pictures' THEN '/home/u/Pictures' ELSE '/home/u/restored-files' END || '/' || {_renamed('clean', 'k')} AS wanted FROM r),
    have AS (SELECT DISTINCT '/home/u/Documents/' || path AS wanted, true AS there FROM entries WHERE root = 'documents' AND size % 3 = 0),
    items AS (SELECT root, path, size, to_root, CASE WHEN there THEN left(wanted, length(wanted) - 4) || ' (kept)' || right(wanted, 4) ELSE wanted END AS dest, CASE WHEN there THEN 'next' ELSE 'write' END AS action,
        k > 1 AS renamed, coalesce(there, false) AS exists, CASE WHEN k > 1 THEN 'collided' WHEN root = 'downloads' THEN 'no-place' END AS note FROM n LEFT JOIN have USING (wanted))"""


def _problems() -> str:
    """The rules of an entry, each over relations of the same entries."""
    from quay import catalog

    docs = [json.loads(x) for x in [*appdb.SAMPLE, *catalog.BROKEN]]
    e = values([(d["id"], d.get("name", ""), d.get("category"), d.get("homepage", ""), d["config"].get("portability"), "windows" in d, "linux" in d) for d in docs])
    ids = values([(d["id"], os, m, owner, p) for d in docs for os in ("windows", "linux") for m, owner in fixed.MANAGERS.items() for p in d.get(os, {}).get(m, [])])
    spots = values([(d["id"], os, k, p) for d in docs for os in ("windows", "linux") for k, p in d.get(os, {}).get("paths", {}).items()])
    sections = values([(d["id"], os, sum(map(len, d[os].values()))) for d in docs for os in ("windows", "linux") if os in d])
    excludes = values([(d["id"], x) for d in docs for x in d["config"].get("exclude", [])])
    equal = values([(d["id"], x) for d in docs for x in d.get("equivalents", [])])
    good, kinds, ports = "^[a-z0-9][a-z0-9-]{0,63}$", values([(c,) for c in fixed.CATEGORIES]), values([(c,) for c in fixed.PORTABILITIES])
    one = lambda code, detail, rest: f"SELECT app_id, '{code}' AS code, {detail} AS detail FROM {rest}"
    rules = [
        one("id-form", "app_id", f"e WHERE NOT regexp_matches(app_id, '{good}')"), one("no-name", "''", "e WHERE trim(name) = ''"), one("category", "coalesce(category, '')", f"e WHERE category IS NULL OR category NOT IN (SELECT c FROM {kinds} AS t(c))"),
        one("homepage", "homepage", "e WHERE homepage <> '' AND NOT regexp_matches(homepage, '^https?://')"), one("no-platform", "''", "e WHERE NOT win AND NOT lin"),
        one("portability", "coalesce(portability, '')", f"e WHERE portability IS NULL OR portability NOT IN (SELECT c FROM {ports} AS t(c))"),
        one("manager-platform", "manager", "(SELECT DISTINCT app_id, manager FROM i WHERE owner <> os)"), one("package-blanks", "manager || ':' || package", "i WHERE trim(package) = '' OR trim(package) <> package"),
        one("package-spaces", "manager || ':' || package", "i WHERE manager NOT IN ('snap', 'registry') AND regexp_matches(package, '[ \t]')"), one("empty-section", "os", "sec WHERE n = 0"),
        one("path-key", "key", f"s WHERE NOT regexp_matches(key, '{good}')"),
        one("path-prefix", "path", r"s WHERE NOT CASE WHEN os = 'linux' THEN regexp_matches(path, '^(~|\$XDG_(CONFIG|DATA|STATE)_HOME)/.') ELSE regexp_matches(path, '^%(APPDATA|LOCALAPPDATA|USERPROFILE)%/.') END"),
        one("path-form", "path", r"s WHERE regexp_matches(path, '\\|//|/$|/\.\.?/')"), one("none-with-paths", "''", "e WHERE portability = 'none' AND app_id IN (SELECT app_id FROM s)"),
        one("paths-missing", "''", "e WHERE portability <> 'none' AND app_id NOT IN (SELECT app_id FROM s)"),
        one("no-shared-key", "''", "e WHERE portability = 'identical' AND app_id IN (SELECT app_id FROM s GROUP BY app_id HAVING count(DISTINCT os) = 2) AND app_id NOT IN (SELECT app_id FROM s GROUP BY app_id, key HAVING count(DISTINCT os) = 2)"),
        one("exclude-form", "pattern", "x WHERE pattern = '' OR starts_with(pattern, '/') OR ends_with(pattern, '/')"), one("exclude-glob", "pattern", r"x WHERE regexp_matches(regexp_replace(pattern, '\[[^\]]+\]', '', 'g'), '[\[\\]')"),
        one("own-equivalent", "''", "q WHERE eq = app_id"), one("equivalent-twice", "eq", "q GROUP BY app_id, eq HAVING count(*) > 1"), one("equivalent-unknown", "eq", "(SELECT DISTINCT app_id, eq FROM q WHERE eq NOT IN (SELECT app_id FROM e))"),
        one("package-claimed", "manager || ':' || key", "(SELECT DISTINCT app_id, manager, key FROM k WHERE app_id <> (SELECT min(o.app_id) FROM k o WHERE o.manager = k.manager AND o.key = k.key))"),
    ]
    return f"""WITH e AS (SELECT * FROM {e} AS t(app_id, name, category, homepage, portability, win, lin)), i AS (SELECT * FROM {ids} AS t(app_id, os, manager, owner, package)), s AS (SELECT * FROM {spots} AS t(app_id, os, key, path)),
        sec AS (SELECT * FROM {sections} AS t(app_id, os, n)), x AS (SELECT * FROM {excludes} AS t(app_id, pattern)), q AS (SELECT * FROM {equal} AS t(app_id, eq)),
        k AS (SELECT app_id, manager, lower(CASE WHEN manager = 'snap' THEN string_split(package, ' ')[1] ELSE package END) AS key FROM i WHERE manager <> 'registry') """ + " UNION ALL ".join(rules)


def sql() -> dict[str, str]:
    from quay import catalog

    scan, files, human = f"WITH {_scan()}", f"WITH {_files()}", _human("size")
    package, volumes = f"WITH {_package(catalog.BLOCK)}", f"WITH {_volumes(catalog.BLOCK, catalog.VOLUME, catalog.RESERVE)}"
    split, matched, plan = f"WITH {_roots()}", f"WITH {_sightings()}", f"WITH {_manifest()}"
    ratio = values([(lv, c, lo, hi, float(fixed.SPEED[lv] if c in ("text", "binary") else fixed.STORED_SPEED)) for lv, t in fixed.RATIOS.items() for c, (lo, hi) in t.items()])
    runtime = " OR ".join(f"starts_with(lower(trim(package)), '{p}')" for p in fixed.RUNTIME_PREFIXES)
    globs = [(g.lower(), glob_regex(g.lower())) for g in catalog.GLOBS]
    segment_globs, whole_globs = ([r for g, r in globs if r is not None and ("/" in g) == whole] for whole in (False, True))
    windows, restore = _windows("url"), f"WITH {_restore()}"
    no_line = r"""NOT (json_valid(text) AND CASE WHEN json_valid(text) THEN json_type(text) IN ('OBJECT', 'NULL') AND coalesce(json_type(text, '$.t'), 'NULL') IN ('VARCHAR', 'NULL') AND coalesce(json_type(text, '$.n'), 'NULL') IN ('UBIGINT', 'NULL')
        AND coalesce(json_type(text, '$.at'), 'NULL') IN ('VARCHAR', 'NULL') AND coalesce(regexp_matches(text ->> '$.at', '^\d{4}-\d\d-\d\dT'), true) END)"""
    broken = ", ".join("'" + x + "'" for x in catalog.TORN)
    out = {
        "file_classes": f"{scan} SELECT seq, class FROM classed",
        "class_buckets": f"{scan} SELECT * FROM buckets",
        "skipped_by_rule": f"{scan} SELECT rule, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM scan WHERE rule IS NOT NULL GROUP BY rule",
        "secret_buckets": f"{scan} SELECT secret, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM scan WHERE rule IS NULL AND secret IS NOT NULL GROUP BY secret",
        "largest_files": f"{scan} SELECT seq, path, size, class FROM scan WHERE rule IS NULL AND secret IS NULL ORDER BY size DESC, seq LIMIT 15",
        "composition": f"{scan} SELECT class, files, bytes, round(100.0::DOUBLE * bytes / (SELECT sum(bytes) FROM buckets)::DOUBLE, 6) AS percent FROM buckets",
        "estimate_levels": f"""{scan}, r AS (SELECT * FROM {ratio} AS t(level, class, lo, hi, speed)),
            e AS (SELECT level, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS raw, CAST(coalesce(sum(floor(bytes::DOUBLE * lo::DOUBLE)), 0) AS BIGINT) AS min_bytes, CAST(coalesce(sum(floor(bytes::DOUBLE * hi::DOUBLE)), 0) AS BIGINT) AS max_bytes, coalesce(sum(bytes::DOUBLE / speed::DOUBLE), 0) AS sec FROM r LEFT JOIN buckets USING (class) GROUP BY level)
            SELECT CAST(level AS INTEGER) AS level, raw, min_bytes, max_bytes, CAST((max_bytes + {fixed.VOLUME_SIZE - 1}) // {fixed.VOLUME_SIZE} AS INTEGER) AS volumes, round(sec / 8 * {fixed.SERIAL_FACTOR}::DOUBLE, 6) AS seconds, false AS sampled, max_bytes <= 1000000000 AS fits, 1000000000 - max_bytes AS left_over FROM e""",
        "human_sizes": rf"{files} SELECT seq, {human} AS shown, reverse(regexp_replace(reverse(CAST(size AS VARCHAR)), '([0-9]{{3}})', '\1 ', 'g')) AS c0 FROM files",
        "root_split": f"{split} SELECT seq, root, rel FROM split",
        "root_join": f"{split} SELECT seq, CASE WHEN split.root = 'other' THEN '/home/u/restored-files' ELSE root_path END || CASE WHEN rel IN ('.', '') THEN '' ELSE '/' || rel END AS dest FROM split LEFT JOIN roots USING (root)",
        "root_summary": f"""{split}, d AS (SELECT *, size > 0 AND seq > min(seq) OVER (PARTITION BY sha256, size) AS dup FROM split)
            SELECT CASE WHEN starts_with(root, 'apps/') THEN 'apps' ELSE root END AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (dup) AS dups, count(DISTINCT CASE WHEN starts_with(root, 'apps/') THEN root END) AS app_roots FROM d GROUP BY 1""",
        "file_dedup": f"{files} SELECT seq, size > 0 AND seq > min(seq) OVER w AS dup, CASE WHEN size > 0 THEN min(seq) OVER w ELSE seq END AS original FROM files WINDOW w AS (PARTITION BY sha256, size)",
        "same_size_files": f"{files} SELECT seq, size FROM files QUALIFY count(*) OVER (PARTITION BY size) > 1",
        "dedup_savings": f"{files}, d AS (SELECT size, size > 0 AND seq > min(seq) OVER (PARTITION BY sha256, size) AS dup FROM files) SELECT count(*) FILTER (dup) AS dups, CAST(coalesce(sum(size) FILTER (dup), 0) AS BIGINT) AS saved_bytes FROM d",
        "solid_parts": f"{package} SELECT seq, solid, off, len FROM solid",
        "stored_parts": f"{package} SELECT seq, k, len FROM stored",
        "block_ids": f"{package} SELECT block_id, kind, raw FROM blocks",
        "block_parts": f"{package} SELECT * FROM parts",
        "volume_fold": f"{volumes} SELECT * FROM located",
        "volume_summary": f"{volumes} SELECT volume, count(*) AS blocks, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(raw + {fixed.BLOCK_HEAD}) + {fixed.VOLUME_HEAD} AS BIGINT) AS bytes FROM located JOIN blocks USING (block_id) GROUP BY volume",
        "needed_volumes": f"{volumes} SELECT DISTINCT volume FROM located JOIN parts USING (block_id) JOIN files USING (seq) WHERE starts_with(path, '/home/u/Documents/Photos/')",
        "placed_files": f"""{volumes}, p AS (SELECT seq, sum(len) AS len, bool_and(volume IS NOT NULL) AS inside FROM parts LEFT JOIN (SELECT * FROM located WHERE volume <> 2) USING (block_id) GROUP BY seq)
            SELECT files.seq, size, size = 0 OR coalesce(inside AND len = size, false) AS placed FROM files LEFT JOIN p USING (seq)""",
        "volume_index": f"{volumes} SELECT DISTINCT volume, seq FROM located JOIN parts USING (block_id)",
        "sums_check": f"""{files}, want AS (SELECT path AS name, sha256 AS w FROM files WHERE seq % 13 <> 0), have AS (SELECT path AS name, CASE WHEN seq % 11 = 0 THEN upper(sha256) WHEN seq % 17 = 0 THEN NULL ELSE sha256 END AS h FROM files WHERE seq % 7 <> 3)
            SELECT * FROM (SELECT name, CASE WHEN w IS NOT NULL AND h IS NULL THEN 'unreadable' WHEN w <> h THEN 'checksum mismatch' WHEN w IS NULL THEN 'not in the sums' END AS problem FROM want FULL JOIN have USING (name)) WHERE problem IS NOT NULL""",
        "missing_volumes": "SELECT event_id AS volume, printf('volumes/%05d.vol', event_id) AS name FROM events WHERE event_id % 50 = 7",
        "torn_journal": f"""WITH j AS (SELECT event_id AS line, CASE WHEN event_id % 4001 = 4000 THEN ([{broken}])[event_id % {len(catalog.TORN)} + 1] WHEN event_id % 10 = 3 THEN '  ' ELSE '{{"t":"' || event_type || '","n":' || event_id || ',"extra":[1],"at":"2024-01-02T03:04:05Z"}}' END AS text FROM events),
            f AS (SELECT * FROM j WHERE trim(text) <> '') SELECT * FROM f WHERE line < coalesce((SELECT min(line) FROM f WHERE {no_line}), 9000000000)""",
        "trailer_check": "SELECT user_id AS volume, count(*) AS in_stream, count(*) + CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END AS in_trailer, CASE WHEN user_id % 10 <> 1 THEN count(*) ELSE -1 END AS in_index FROM events GROUP BY user_id HAVING user_id % 9 = 0 OR user_id % 10 = 1",
        "reassembly": f"""{package} SELECT m.seq, CASE WHEN bool_or(coalesce(block_id % 97 = 5, false)) THEN 'incomplete' WHEN bool_or(coalesce(block_id % 89 = 3 AND off = 0, false)) THEN 'damaged' ELSE 'ok' END AS status FROM mine m LEFT JOIN parts USING (seq) GROUP BY m.seq""",
        "sanitized": rf"""SELECT page_id, {windows} AS windows, url AS linux, CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^.+\.') THEN regexp_replace(url, '(\.[^./]*)$', ' (2)\1') ELSE url || ' (2)' END AS suffixed FROM pages""",
        "package_match": f"{matched} SELECT seq, via, package, app_id FROM matched",
        "unknown_apps": f"{matched} SELECT via, package, count(*) AS n, count(DISTINCT machine) AS machines FROM matched WHERE app_id IS NULL AND CASE WHEN via IN {fixed.DESKTOP_MANAGERS} THEN desktop WHEN via = 'registry' THEN NOT ({runtime}) ELSE true END GROUP BY via, package",
        "found_apps": f"{matched} SELECT machine, app_id, arg_min(version, seq) FILTER (version IS NOT NULL) AS version, string_agg(via || ':' || package, ',' ORDER BY seq) AS sources FROM matched WHERE app_id IS NOT NULL GROUP BY machine, app_id",
        "install_plan": f"""{plan} SELECT app_id, bucket, CASE WHEN stands_in THEN q ELSE app_id END AS target_id, CASE WHEN stands_in THEN q_via ELSE own_via END AS via, CASE WHEN stands_in THEN q_m ELSE own_m END AS manager, CASE WHEN stands_in THEN q_p ELSE own_p END AS package,
            CASE WHEN bucket = 'no_source' THEN needs END AS needs, stands_in, CASE WHEN bucket = 'missing' THEN 'unknown-app' END AS reason FROM plan""",
        "config_plan": f"""{plan}, c AS (SELECT app_id, CAST(v.ord AS BIGINT) AS ord, key, variant FROM spots, (VALUES (0, 'flatpak'), (1, ''), (2, 'snap')) AS v(ord, variant) WHERE os = 'windows'),
            j AS (SELECT c.*, apps.is_on, portability, s.path, CASE WHEN here.via = 'flatpak' THEN 'flatpak' ELSE '' END AS want, here.via IS NULL AND (p.bucket IS NULL OR p.bucket <> 'install' OR p.stands_in) AS absent FROM c LEFT JOIN apps USING (app_id) LEFT JOIN spots s ON s.app_id = c.app_id AND s.key = c.key AND s.os = 'linux' LEFT JOIN here ON here.app_id = c.app_id LEFT JOIN plan p ON p.app_id = c.app_id),
            w AS (SELECT *, CASE WHEN is_on IS NULL THEN 'unknown-app' WHEN NOT is_on THEN 'no-version' WHEN path IS NULL THEN 'no-location' WHEN portability = 'translatable' THEN 'needs-translation'
              WHEN portability = 'untranslatable' THEN 'platform-bound' WHEN portability <> 'identical' THEN 'does-not-travel' WHEN absent THEN 'app-absent' END AS why FROM j),
            b AS (SELECT *, row_number() OVER (PARTITION BY app_id, key ORDER BY CASE WHEN variant = want THEN 0 WHEN variant = '' THEN 1 ELSE 2 END, ord) = 1 AND why IS NULL AS chosen FROM w)
            SELECT app_id, ord, key, variant, CASE WHEN chosen THEN 'place' ELSE 'aside' END AS action, CASE WHEN chosen THEN replace(path, '~', '/home/u') END AS dest, CASE WHEN NOT chosen THEN coalesce(why, 'other-copy-placed') END AS reason FROM b""",
        "install_commands": f"""{plan}, i AS (SELECT DISTINCT pos, own_m AS manager, own_p AS package FROM plan WHERE bucket = 'install' AND NOT stands_in)
            SELECT row_number() OVER (ORDER BY r, step) - 1 AS n, manager, argv, env, prep, batch FROM (
              SELECT 0 AS r, 1 AS step, manager, 'sudo pacman -Syu --needed --noconfirm ' || string_agg(package, ' ' ORDER BY pos) AS argv, '' AS env, false AS prep, true AS batch FROM i WHERE manager = 'pacman' GROUP BY manager
              UNION ALL SELECT 1, 0, manager, 'sudo apt-get update', 'DEBIAN_FRONTEND=noninteractive', true, false FROM i WHERE manager = 'apt' GROUP BY manager
              UNION ALL SELECT 1, 1, manager, 'sudo apt-get install -y ' || string_agg(package, ' ' ORDER BY pos), 'DEBIAN_FRONTEND=noninteractive', false, true FROM i WHERE manager = 'apt' GROUP BY manager)""",
        "command_outcomes": "SELECT event_id AS n, CASE WHEN coalesce(max(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' WHEN event_id % 20 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM events",
        "resolved_paths": """SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE CASE page_id % 3 WHEN 0 THEN CASE page_id % 5 WHEN 0 THEN '/home/u' WHEN 1 THEN '/home/u/.config' WHEN 2 THEN '/data' ELSE '/home/u/.local/state' END
            WHEN 1 THEN '/home/u/.var/app/org.x' || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/config' WHEN 2 THEN '/data' ELSE '/.local/state' END
            ELSE '/home/u/snap/org.x/current' || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/.config' WHEN 2 THEN '/.local/share' ELSE '/.local/state' END END || '/app/' || page_id END AS abs FROM pages""",
        "excluded_globs": f"{files}, r AS (SELECT seq, lower(path[9:]) AS rel FROM files) SELECT seq, len(list_filter(string_split(rel, '/'), lambda s: {' OR '.join(f"regexp_full_match(s, '{g}')" for g in segment_globs)})) > 0 OR {' OR '.join(f"regexp_full_match(rel, '{g}')" for g in whole_globs)} AS excluded FROM r",
    }
    out |= {
        "conflict_actions": f"{restore} SELECT root, path, to_root, dest, action, renamed, exists, note FROM items",
        "restore_totals": f"{restore} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (exists) AS conflicts, count(*) FILTER (renamed) AS renamed, 0 AS skipped FROM items",
        "restore_roots": f"{restore} SELECT to_root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM items GROUP BY to_root",
        "collision_rename": f"WITH {_entries()}, c AS (SELECT root, path, {_windows('path')} AS clean FROM entries), r AS (SELECT *, row_number() OVER (PARTITION BY root, lower(clean) ORDER BY root, path) AS k FROM c) SELECT root, path, clean, {_renamed('clean', 'k')} AS final FROM r",
        "codec_round_trip": f"{files} SELECT seq AS block_id, (['stored', 'deflate', 'zstd', 'xz'])[seq % 4 + 1] AS codec, size AS raw, true AS ok FROM files",
        "appdb_problems": _problems(),
    }
    out["human_sizes"] = rf"{files} SELECT seq, {human} AS shown, trim(reverse(regexp_replace(reverse(CAST(size AS VARCHAR)), '([0-9]{{3}})', '\1 ', 'g'))) AS counted FROM files"
    return out
