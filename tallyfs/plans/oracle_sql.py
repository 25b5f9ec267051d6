"""DuckDB SQL equal in meaning to each registered query (the driver's oracle).

The corpus naming is restated here in SQL from the fixture rules; hidden and
excluded flags are set by construction, so the Spark code that *derives* them
from names and paths is checked, not echoed.
"""

from __future__ import annotations

# Fixed values, stated here again so that a wrong one in the code shows.
CATEGORIES = {
    "Images": ("png", "jpg", "gif", "bmp", "webp", "jpeg"),
    "Documents": ("txt", "pdf", "doc", "docx", "ppt", "pptx"),
    "Audio": ("mp3", "wav", "aac"),
    "Video": ("mp4", "mkv", "avi", "mov"),
    "Archive": ("zip", "rar", "7z", "tar", "gz"),
    "Source Code": ("java", "py", "cpp", "c", "js", "html", "css", "go"),
}


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_category(ext: str) -> str:
    parts = [f"case when {ext} is null or {ext} = '' then 'No extension'"]
    for cat, exts in CATEGORIES.items():
        parts.append(f"when {ext} in ({_sql_list(exts)}) then '{cat}'")
    return " ".join(parts) + " else 'Others' end"


def sql_size_text(x: str) -> str:
    return (f"(case when {x} is null then null "
            f"when {x} < 1024 then cast({x} as varchar) || 'B' "
            f"when {x} < 1048576 then printf('%.2f KB', round({x} / 1024.0, 2)) "
            f"when {x} < 1073741824 then printf('%.2f MB', round({x} / 1048576.0, 2)) "
            f"else printf('%.2f GB', round({x} / 1073741824.0, 2)) end)")


def sql_label(ext: str) -> str:
    return f"(case when {ext} is null or {ext} = '' then 'No extension' else {ext} end)"


CORPUS = """
b as (
  select doc_id, source, lang, encode(text) as content,
         (['TXT','pdf','jpg','html','py','java','mp4','csv','tar.gz','','json','md','png','mp3','zip','docx'])
           [cast(doc_id % 16 as int) + 1] as e,
         case when doc_id % 10 = 0 then 'node_modules' when doc_id % 10 = 1 then 'Bin'
              when doc_id % 10 = 2 then 'wow!' else 'docs' end as dir
  from documents),
n as (
  select *, (case when doc_id % 23 = 0 then '.' else '' end) || 'doc_' || doc_id
            || (case when e = '' then '' else '.' || e end) as name
  from b),
f as (
  select doc_id, name,
         case when doc_id % 7 = 3 then '/corpus/' || source || '/bundle.zip!/' || dir || '/' || name
              else '/corpus/' || source || '/' || lang || '/' || dir || '/' || name end as path,
         cast(octet_length(content) as bigint) as size,
         case when contains(name, '.') then lower(split_part(name, '.', -1)) else '' end as extension,
         doc_id % 7 = 3 as from_archive,
         case when doc_id % 7 = 3 then '/corpus/' || source || '/bundle.zip' end as archive_path,
         starts_with(name, '.') as hidden,
         dir not in ('docs', 'wow!') as excluded,
         content
  from n),
elig as (select path, size, content from f where not from_archive and not hidden and not excluded)
"""

FOLDERS = """
par as (select distinct regexp_extract(coalesce(archive_path, path), '^(.*)/[^/]*$', 1) as d from f),
dirs as (
  select distinct array_to_string(string_split(d, '/')[1:k], '/') as path
  from (select d, unnest(generate_series(3, len(string_split(d, '/')))) as k
        from par where starts_with(d, '/corpus/')))
"""

TOTALS = """
tot as (
  select (select count(*) from f) as files,
         (select count(*) from dirs) as folders,
         (select cast(coalesce(sum(size), 0) as bigint) from f) as bytes,
         cast(0 as bigint) as skipped)
"""

GROUPS = """
g as (select sha256(content) as full_hash, size, count(*) as copies
      from elig group by 1, 2 having count(*) >= 2),
gf as (select sha256(e.content) as full_hash, e.size, e.path
       from elig e join g on sha256(e.content) = g.full_hash and e.size = g.size)
"""

URLS = """
u as (select url as path, regexp_extract(url, '^[^?#]*/([^/?#]*)', 1) as name,
             cast(octet_length(encode(html)) as bigint) as size from pages),
uf as (select *, case when contains(name, '.') then lower(split_part(name, '.', -1)) else '' end as extension
       from u)
"""

Q = 8192

BUNDLE = "'/corpus/bundle_' || cast(doc_id // 64 as varchar) || '.zip'"
ENTRIES = (f"select {BUNDLE} || '!/' || source || '/' || lang || '/doc_' || cast(doc_id as varchar) || '.TXT' as path, "
           "'doc_' || cast(doc_id as varchar) || '.TXT' as name, "
           "cast(octet_length(encode(text)) as bigint) as size, 'txt' as extension, "
           f"true as from_archive, {BUNDLE} as archive_path from documents")
PLAIN = ("select '/corpus/benchmark/item_' || cast(item_id as varchar) || '.txt' as path, "
         "'item_' || cast(item_id as varchar) || '.txt' as name, "
         "cast(octet_length(encode(text)) as bigint) as size, 'txt' as extension, "
         "false as from_archive, cast(null as varchar) as archive_path from benchmark")
# The document tree: every document a file on disk, the corpus's archive
# entries plain files below a directory named bundle.zip. Files named *.zip
# hold text, so they are unreadable archives and vanish from the inventory.
DOC_TREE = """
t as (select name, replace(path, 'bundle.zip!/', 'bundle.zip/') as path, size, extension, hidden, excluded, content
      from f where extension <> 'zip'),
telig as (select path, size, content from t where not hidden and not excluded),
tpar as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as d from t),
tdirs as (
  select distinct array_to_string(string_split(d, '/')[1:k], '/') as path
  from (select d, unnest(generate_series(3, len(string_split(d, '/')))) as k
        from tpar where starts_with(d, '/corpus/'))),
tg as (select sha256(content) as full_hash, size, count(*) as copies
       from telig group by 1, 2 having count(*) >= 2)
"""
# The same tree with broken links and FIFOs beside some documents.
ODD = """
every as (select doc_id, excluded, replace(path, 'bundle.zip!/', 'bundle.zip/') as path from f),
links as (select path || '.lnk' as path from every where doc_id % 97 = 5),
pipes as (select 'pipe_' || doc_id as name, regexp_replace(path, '[^/]*$', '') || 'pipe_' || doc_id as path, excluded
          from every where doc_id % 89 = 7),
opar as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as d from every),
odirs as (
  select distinct array_to_string(string_split(d, '/')[1:k], '/') as path
  from (select d, unnest(generate_series(3, len(string_split(d, '/')))) as k
        from opar where starts_with(d, '/corpus/'))),
zero as (select (select count(*) from pipes where not excluded) + (select count(*) from telig where size = 0) as n)
"""


# The corpus before and after documents go, grow by a byte and move.
DIFF = """
after as (
  select case when doc_id % 17 = 6 then path || '.moved' else path end as path,
         case when doc_id % 13 = 4 then size + 1 else size end as size
  from f where doc_id % 11 <> 3),
diff as (
  select coalesce(f.path, a.path) as path, f.size as size_before, a.size as size_after,
         case when f.path is null then 'added' when a.path is null then 'removed'
              when f.size is distinct from a.size then 'changed' else 'unchanged' end as status
  from f full join after a on f.path = a.path)
"""


def _with(*ctes: str) -> str:
    return "with " + ",".join(c.strip() for c in ctes) + "\n"


EXT_COUNTS = f"select {sql_label('extension')} as extension, count(*) as n from f group by 1"
CAT_SIZES = (f"select {sql_category('extension')} as category, "
             f"cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) as n from f group by 1")
DUP_SUMMARY = ("select count(*) as groups, count(*) > 0 as has_duplicates, "
               "cast(coalesce(sum(copies), 0) as bigint) as duplicate_files, "
               "cast(coalesce(sum(size * copies), 0) as bigint) as duplicate_bytes, "
               "cast(coalesce(sum(size * (copies - 1)), 0) as bigint) as wasted_bytes from g")


def _summary_rows(full: bool) -> str:
    parts = [
        "select 'summary' as section, 'files' as key, files as value, cast(null as varchar) as size_text from tot",
        "select 'summary', 'folders', folders, null from tot",
        f"select 'summary', 'bytes', bytes, {sql_size_text('bytes')} from tot",
        "select 'summary', 'skipped', skipped, null from tot",
        f"select 'extensions', extension, n, null from ({EXT_COUNTS} order by n desc, extension limit 10)",
        f"select 'categories', category, bytes, {sql_size_text('bytes')} from ({CAT_SIZES})",
        f"select 'largest_files', path, size, {sql_size_text('size')} "
        f"from (select path, size from f order by size desc, path limit 5)",
    ]
    ctes = [CORPUS, FOLDERS, TOTALS]
    if full:
        ctes.append(GROUPS)
        parts += [
            "select 'duplicates', 'groups', groups, null from ds",
            f"select 'duplicates', 'duplicate_bytes', duplicate_bytes, {sql_size_text('duplicate_bytes')} from ds",
            f"select 'duplicates', 'wasted_bytes', wasted_bytes, {sql_size_text('wasted_bytes')} from ds",
        ]
        ctes.append(f"ds as ({DUP_SUMMARY})")
    return _with(*ctes) + "\nunion all\n".join(parts)


ORACLE_SQL: dict[str, str] = {
    "scan_summary": _with(CORPUS, FOLDERS, TOTALS) + "select files, folders, bytes, skipped from tot",
    "extension_counts": _with(CORPUS) + EXT_COUNTS,
    "top_extensions": _with(CORPUS) + EXT_COUNTS + " order by n desc, extension limit 10",
    "all_extensions": _with(CORPUS) + EXT_COUNTS,
    "category_sizes": _with(CORPUS) + CAT_SIZES,
    "category_labels": _with(CORPUS) + f"select category, bytes, {sql_size_text('bytes')} as size_text "
                                       f"from ({CAT_SIZES})",
    "largest_files": _with(CORPUS) + f"select path, name, size, extension, {sql_size_text('size')} as size_text "
                                     "from f order by size desc, path limit 5",
    "largest_file": _with(CORPUS) + f"select path, name, size, extension, {sql_size_text('size')} as size_text "
                                    "from f order by size desc, path limit 1",
    "size_text": _with(CORPUS) + f"select path, size, {sql_size_text('size')} as size_text from f",
    "leaf_names": _with(CORPUS) + "select path, name, extension, from_archive, archive_path from f",
    "file_categories": _with(CORPUS) + f"select path, extension, {sql_category('extension')} as category from f",
    "folder_rows": _with(CORPUS, FOLDERS) + "select path, regexp_extract(path, '([^/]*)$', 1) as name from dirs",
    "hidden_files": _with(CORPUS) + "select path, name from f where hidden",
    "excluded_files": _with(CORPUS) + "select path from f where excluded",
    "hash_eligible": _with(CORPUS) + "select path, size from elig",
    "size_groups": _with(CORPUS) + "select size, count(*) as n from f group by size having count(*) >= 2",
    "candidates": _with(CORPUS) + "select path, size from elig "
                                  "where size in (select size from f group by size having count(*) >= 2)",
    "quick_groups": _with(CORPUS) + f"select size, sha256(content[1:{Q}]) as quick_hash, count(*) as n "
                                    "from elig group by 1, 2 having count(*) >= 2",
    "duplicate_groups": _with(CORPUS, GROUPS) + "select full_hash, size, copies from g",
    "duplicate_summary": _with(CORPUS, GROUPS) + DUP_SUMMARY,
    "duplicate_listing": _with(CORPUS, GROUPS) + (
        "select n.group_no, gf.full_hash, gf.size, gf.path from gf join "
        "(select full_hash, size, row_number() over (order by size desc, full_hash) as group_no from g) n "
        "on gf.full_hash = n.full_hash and gf.size = n.size"),
    "reclaimable_files": _with(CORPUS, GROUPS) + (
        "select full_hash, size, path from (select *, row_number() over "
        "(partition by full_hash, size order by path) as rn from gf) where rn > 1"),
    "funnel_stats": _with(CORPUS, GROUPS) + f"""
, c as (select count(*) as cand from elig
        where size in (select size from f group by size having count(*) >= 2)),
  s as (select count(*) as files from f),
  q as (select count(*) as surv from elig e join
          (select size, sha256(content[1:{Q}]) as qh from elig group by 1, 2 having count(*) >= 2) k
          on e.size = k.size and sha256(e.content[1:{Q}]) = k.qh),
  d as (select count(*) as dupf from gf)
select 1 as tier, 'size' as stage, files as files_in, cand as files_out from s, c
union all select 2, 'quick_hash', cand, surv from c, q
union all select 3, 'full_hash', surv, dupf from q, d""",
    "summary_rows": _summary_rows(True),
    "quick_preset": _summary_rows(False),
    "url_extensions": _with(URLS) + f"select {sql_label('extension')} as extension, count(*) as n from uf group by 1",
    "url_categories": _with(URLS) + (f"select {sql_category('extension')} as category, "
                                     "cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) as n "
                                     "from uf group by 1"),
    "archive_entries": ENTRIES,
    "tar_entries": ENTRIES.replace(".zip'", ".tar'"),
    "split_entries": ENTRIES,
    "split_ranges": (
        f"select path, cast(sum(n) as bigint) as directory_bytes, cast(ceil(sum(n) / 1024.0) as bigint) as ranges from "
        f"(select {BUNDLE} as path, 46 + octet_length(encode(source || '/' || lang || '/doc_' || cast(doc_id as varchar) || '.TXT')) as n "
        f"from documents union all select path, 46 + octet_length(encode(source || '/')) from (select distinct {BUNDLE} as path, source from documents)) "
        "group by path having sum(n) > 1024"),
    "archive_errors": "select '/corpus/pages/page_' || cast(page_id as varchar) || '.zip' as path from pages",
    "expand_archives": PLAIN + " union all " + ENTRIES,
    "doc_tree_summary": _with(CORPUS, DOC_TREE) + (
        "select (select count(*) from t) as files, (select count(*) from tdirs) as folders, "
        "(select cast(coalesce(sum(size), 0) as bigint) from t) as bytes, cast(0 as bigint) as skipped"),
    "doc_tree_files": _with(CORPUS, DOC_TREE) + "select path, name, size, extension from t",
    "doc_tree_duplicates": _with(CORPUS, DOC_TREE) + "select full_hash, size, copies from tg",
    "doc_tree_listing": _with(CORPUS, DOC_TREE) + (
        "select n.group_no, n.full_hash, n.size, e.path from telig e join "
        "(select full_hash, size, row_number() over (order by size desc, full_hash) as group_no from tg) n "
        "on sha256(e.content) = n.full_hash and e.size = n.size"),
    "doc_tree_archive_errors": _with(CORPUS) + "select replace(path, 'bundle.zip!/', 'bundle.zip/') as path from f where extension = 'zip'",
    "tree_inventory": _with(CORPUS, DOC_TREE, ODD) + (
        "select 'file' as kind, name, size, extension from t union all select 'file', name, 0, '' from pipes "
        "union all select 'dir', regexp_extract(path, '([^/]*)$', 1), null, null from odirs "
        "union all select 'skipped', regexp_extract(path, '([^/]*)$', 1), null, null from links"),
    "tree_summary": _with(CORPUS, DOC_TREE, ODD) + (
        "select (select count(*) from t) + (select count(*) from pipes) as files, (select count(*) from odirs) as folders, "
        "(select cast(coalesce(sum(size), 0) as bigint) from t) as bytes, (select count(*) from links) as skipped"),
    "tree_duplicate_summary": _with(CORPUS, DOC_TREE) + DUP_SUMMARY.replace("from g", "from tg"),
    "skipped_items": _with(CORPUS, DOC_TREE, ODD) + "select path, 'not readable' as error from links",
    "hash_errors": _with(CORPUS, DOC_TREE, ODD) + (
        "select path, cast(0 as bigint) as size, 'OSError: not a regular file' as error from pipes, zero "
        "where not excluded and zero.n >= 2"),
    "cached_groups": _with(CORPUS, DOC_TREE) + (
        "select sha256(c) as full_hash, octet_length(c) as size, count(*) as copies from "
        "(select case when doc_id % 13 = 4 then content || encode('x') else content end as c from f "
        "where extension <> 'zip' and not hidden and not excluded) group by 1, 2 having count(*) >= 2"),
    "scan_diff": _with(CORPUS, DIFF) + "select path, status, size_before, size_after from diff",
    "diff_summary": _with(CORPUS, DIFF) + (
        "select status, count(*) as files, cast(coalesce(sum(size_before), 0) as bigint) as bytes_before, "
        "cast(coalesce(sum(size_after), 0) as bigint) as bytes_after from diff group by status"),
    "report_csv": _with(CORPUS) + (
        f"select 'categories' as section, category as key, n, bytes, {sql_size_text('bytes')} as size_text from ({CAT_SIZES}) "
        f"union all select 'extensions', extension, n, null, null from ({EXT_COUNTS} order by n desc, extension limit 10)"),
    "committed_reports": _with(CORPUS) + (
        f"select category, bytes, n, {sql_size_text('bytes')} as size_text, 'whole' as scan_id from ({CAT_SIZES})"),
    "report_text": "with s as (" + _summary_rows(True) + "), " + _with(CORPUS, GROUPS)[5:] + (
        "select section || chr(9) || key || ' -> ' || coalesce(size_text, cast(value as varchar)) as line from s "
        f"union all select cast(n.group_no as varchar) || chr(9) || {sql_size_text('gf.size')} || chr(9) || gf.path from gf join "
        "(select full_hash, size, row_number() over (order by size desc, full_hash) as group_no from g) n "
        "on gf.full_hash = n.full_hash and gf.size = n.size"),
    "user_categories": _with(CORPUS) + (
        "select category, cast(sum(size) as bigint) as bytes, count(*) as n from (select f.size, "
        "case when extension = '' then 'No extension' else coalesce(c, 'Others') end as category from f left join "
        "(select extension, min(name) as c from f where extension not in ('pdf', '') group by 1) d using (extension)) group by 1"),
    "compressed_entries": (
        "with c as (select *, (doc_id // 64) % 3 as k, cast(octet_length(encode(text)) as bigint) as n, "
        "case when (doc_id // 64) % 3 = 2 then '/corpus/doc_' || doc_id || '.TXT.gz' else '/corpus/bundle_' || (doc_id // 64) "
        "|| case when (doc_id // 64) % 3 = 0 then '.tar.gz' else '.tar.xz' end end as box from documents) "
        "select box || '!/' || case when k = 2 then '' else source || '/' || lang || '/' end || 'doc_' || doc_id || '.TXT' as path, "
        "'doc_' || doc_id || '.TXT' as name, case when k < 2 then n end as size, 'txt' as extension, true as from_archive, "
        "box as archive_path from c"),
    "store_files": _with(CORPUS, DOC_TREE) + "select path, name, size, extension from t",
    "store_duplicates": _with(CORPUS, DOC_TREE) + "select full_hash, size, copies from tg",
    "store_archive_errors": _with(CORPUS) + "select replace(path, 'bundle.zip!/', 'bundle.zip/') as path from f where extension = 'zip'",
    "store_skipped_items": _with(CORPUS, DOC_TREE, ODD) + "select path, 'not readable' as error from links",
    "store_summary": _with(CORPUS, DOC_TREE, ODD) + (
        "select (select count(*) from t) + (select count(*) from pipes) as files, (select count(*) from odirs) as folders, "
        "(select cast(coalesce(sum(size), 0) as bigint) from t) as bytes, (select count(*) from links) as skipped"),
    "pruned_items": _with(CORPUS, DOC_TREE, ODD) + (
        "select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) || '/$RECYCLE.BIN' as path, 'pruned' as error "
        "from every where doc_id % 41 = 8"),
    "relisted_files": _with(CORPUS) + (
        ", e as (select *, replace(path, 'bundle.zip!/', 'bundle.zip/') as spot from f) "
        "select spot as path, name, size + case when doc_id % 13 = 4 then 1 else 0 end as size, extension from e where doc_id % 31 <> 6 "
        "union all select spot || '.new', name || '.new', size, 'new' from e where doc_id % 29 = 5"),
    "relisted_folders": _with(CORPUS, DOC_TREE, ODD) + (
        ", touched as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as d from every where doc_id % 29 = 5 or doc_id % 31 = 6) "
        "select true as listed, (select count(*) from touched) + 1 as folders "
        "union all select false, (select count(*) from odirs) - (select count(*) from touched)"),
    "incremental_groups": _with(CORPUS, DOC_TREE) + (
        "select sha256(c) as full_hash, octet_length(c) as size, count(*) as copies from "
        "(select case when doc_id % 13 = 4 then content || encode('x') else content end as c from f "
        "where extension <> 'zip' and not hidden and not excluded) group by 1, 2 having count(*) >= 2"),
    "block_groups": _with(CORPUS, DOC_TREE) + "select full_hash, size, copies from tg",
    "block_reads": _with(CORPUS, DOC_TREE) + """
, shared as (select *, count(*) over (partition by size, sha256(content[1:64])) as n from telig),
  read as (select size, sha256(content) as h from shared where n >= 2 and size > 512),
  copied as (select size, h from read group by 1, 2 having count(*) >= 2)
select 'blocks' as stage, count(*) as files, cast(coalesce(sum(size), 0) as bigint) as bytes from read
union all select 'once', count(*), cast(coalesce(sum(size), 0) as bigint) from copied
union all select 'again', 0, 0""",
    "incremental_reads": _with(CORPUS) + f"""
, e as (select doc_id, size s0, sha256(content[1:{Q}]) q0, case when doc_id % 13 = 4 then content || encode('x') else content end c1
        from f where extension <> 'zip' and not hidden and not excluded),
  first as (select * from e where doc_id % 5 <> 0),
  s1 as (select s0 from first group by s0 having count(*) >= 2),
  g1 as (select s0, q0 from first group by s0, q0 having count(*) >= 2),
  now as (select octet_length(c1) as size, sha256(c1[1:{Q}]) as quick,
                 doc_id % 5 <> 0 and doc_id % 13 <> 4 and s0 in (select s0 from s1) as has_quick,
                 doc_id % 5 <> 0 and doc_id % 13 <> 4 and (s0, q0) in (select (s0, q0) from g1) as has_full from e),
  counted as (select *, count(*) over (partition by size) as n_size, count(*) over (partition by size, quick) as n_quick from now)
select 'quick_hash' as stage, count(*) as files, cast(coalesce(sum(least(size, {Q})), 0) as bigint) as bytes
from counted where n_size >= 2 and not has_quick
union all select 'full_hash', count(*), cast(coalesce(sum(size), 0) as bigint) from counted where n_quick >= 2 and size > {Q} and not has_full""",
    "tree_source_files": _with(CORPUS) + (
        "select replace(path, 'bundle.zip!/', 'bundle.zip/') as path, name, size from f where starts_with(path, '/corpus/src1')"),
    "scan_moves": _with(CORPUS) + """
, every as (select doc_id, path, size, content, not from_archive and not hidden and not excluded as ok from f),
  older as (select path, size, case when ok then sha256(content) end as h from every),
  newer as (select case when doc_id % 17 = 6 then path || '.moved' else path end as path,
               case when doc_id % 13 = 4 then size + 1 else size end as size,
               case when ok then sha256(case when doc_id % 13 = 4 then content || encode('x') else content end) end as h
        from every where doc_id % 11 <> 3),
  gone as (select *, row_number() over (partition by h, size order by path) as k from older where path not in (select path from newer)),
  fresh as (select *, row_number() over (partition by h, size order by path) as k from newer where path not in (select path from older))
select coalesce(fresh.path, gone.path) as path, case when fresh.path is null then 'removed' when gone.path is null then 'added'
       else 'moved' end as status, case when fresh.path is not null then gone.path end as path_before,
       coalesce(fresh.size, gone.size) as size
from gone full join fresh on gone.h = fresh.h and gone.size = fresh.size and gone.k = fresh.k""",
}
