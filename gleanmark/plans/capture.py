"""The flat tables of nested capture records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanmark.operators import nested
from gleanmark.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flat_entities(table(spark, folder, "content"))


def _of(table_of):
    return lambda spark, folder: table_of(table(spark, folder, "content"))


QUERIES = {
    "p2_found": p2_found,
    "p2_posts": _of(nested.posts_table),
    "p2_images": _of(nested.images_table),
    "p2_videos": _of(nested.videos_table),
    "p2_items": _of(nested.items_table),
    "p2_media": _of(nested.media_table),
    "p2_comments": _of(nested.comments_table),
    "p2_redirects": _of(nested.redirects_table),
}


def _entries(value: str, source: str) -> str:
    """Rows (content_id, parent, id, node) of the lists of comments in ``value`` of ``source``."""
    listed = f"case when json_type({value}->'items') = 'ARRAY' then ({value}->'items') when json_type({value}->'loaded') = 'ARRAY' then ({value}->'loaded') else {value} end"
    return f"""select content_id, parent, coalesce(nullif(node->>'id', ''), k) as id, node from (select content_id, parent,
          unnest(case when json_type(w) = 'ARRAY' then w::json[] when json_type(w) = 'OBJECT' then list_transform(json_keys(w), lambda x: json_extract(w, '$."' || x || '"')) else [] end) as node,
          unnest(case when json_type(w) = 'ARRAY' then list_transform(w::json[], lambda x: null::varchar) when json_type(w) = 'OBJECT' then json_keys(w) else [] end) as k
          from (select content_id, parent, {listed} as w from {source})) where json_type(node) = 'OBJECT' and coalesce(nullif(node->>'id', ''), k) is not null"""


_MEDIA = "unnest(case when json_type({n}->{k}) = 'ARRAY' then ({n}->{k})::json[] when json_type({n}->{k}) <> 'NULL' then [({n}->{k})] else [] end)"
_ANSWERS = "coalesce(" + ", ".join(f"case when json_type(node->'{k}') <> 'NULL' then (node->'{k}') end" for k in nested.ANSWER_KEYS) + ")"
_ADDRESS = "case when json_type(m) = 'VARCHAR' then (m->>'$') else (m->>'url') end"
_TREES = f"""with recursive c as (select content_id, post, comments, items, url_check from content where content_id is not null),
        j as (select content_id, case when json_type(p) = 'VARCHAR' then case when json_valid(p->>'$') then (p->>'$')::json end else p end as p, case when json_type(t) = 'VARCHAR' then case when json_valid(t->>'$') then (t->>'$')::json end else t end as t
          from (select distinct content_id, case when json_valid(post) then post::json end as p, case when json_valid(comments) then comments::json end as t from c)),
        posts as (select content_id, p, p->>'id' as id from (select content_id, case when json_type(p->'post') = 'OBJECT' then (p->'post') else p end as p from j) where coalesce(p->>'id', '') <> ''),
        comments as ({_entries('v', '(select content_id, content_id::varchar as parent, t as v from j where t is not null)')}
          union all {_entries('v', f"(select content_id, id as parent, {_ANSWERS} as v from comments)")})"""
_PLACED = "unnest(case when json_type({n}->'{k}') = 'ARRAY' then ({n}->'{k}')::json[] when json_type({n}->'{k}') <> 'NULL' then [({n}->'{k}')] else [] end) as m, generate_subscripts(case when json_type({n}->'{k}') = 'ARRAY' then ({n}->'{k}')::json[] when json_type({n}->'{k}') <> 'NULL' then [({n}->'{k}')] else [] end, 1) - 1 as place"
_DETAIL = "case when json_type(m) <> 'VARCHAR' then (m->>'{d}') end"
_ROWS = "(select content_id, i, coalesce(nullif(i.id, ''), nullif(i.url, '')) as item_id from (select content_id, unnest(items) as i from content) where i is not null)"
SQL = {
    "p2_found": f"""{_TREES},
        media as (select content_id, e, id, {_MEDIA.format(n='p', k='k')} as m from posts, (values ('image', 'images'), ('video', 'videos')) v(e, k)
          union all select content_id, 'image', id, {_MEDIA.format(n='node', k="'images'")} from comments),
        its as (select content_id, coalesce(nullif(i.id, ''), nullif(i.url, '')) as id, i.media as media from (select content_id, unnest(items) as i from c) where i is not null)
        select distinct * from (select content_id, 'post' as entity, id as child_id, content_id::varchar as parent_id from posts
          union all select content_id, 'comment', id, parent from comments
          union all select content_id, e, {_ADDRESS}, id from media
          union all select content_id, 'item', id, content_id::varchar from its where id is not null
          union all select content_id, 'media', m.url, id from (select content_id, id, unnest(media) as m from its where id is not null) where m is not null
          union all select content_id, 'redirect', r.url, content_id::varchar from (select content_id, unnest(url_check.redirects) as r from c) where r is not null)
        where coalesce(child_id, '') <> ''""",
    "p2_posts": f"""{_TREES} select distinct content_id, id as post_id, p->>'url' as url, p->>'title' as title, p->>'text' as text, p->'account'->>'name' as account from posts""",
    "p2_images": f"""{_TREES}, m as (select content_id, id, {_PLACED.format(n='p', k='images')} from posts union all select content_id, id, {_PLACED.format(n='node', k='images')} from comments)
        select distinct content_id, id as parent_id, place::int as place, {_ADDRESS} as url, {_DETAIL.format(d='alt')} as alt from m where coalesce({_ADDRESS}, '') <> ''""",
    "p2_videos": f"""{_TREES}, m as (select content_id, id, {_PLACED.format(n='p', k='videos')} from posts)
        select distinct content_id, id as parent_id, place::int as place, {_ADDRESS} as url, {_DETAIL.format(d='poster')} as poster from m where coalesce({_ADDRESS}, '') <> ''""",
    "p2_items": f"select distinct content_id, item_id, i.url as url, i.kind as kind, i.author as author, i.time as time, i.text as text, i.truncated as truncated, i.metrics_text as metrics_text from {_ROWS} where item_id is not null",
    "p2_media": f"select distinct content_id, item_id, (pl - 1)::int as place, m.kind as kind, m.url as url, m.alt as alt, m.loaded as loaded from (select content_id, item_id, unnest(i.media) as m, generate_subscripts(i.media, 1) as pl from {_ROWS} where item_id is not null) where coalesce(m.url, '') <> ''",
    "p2_comments": f"""{_TREES} select distinct content_id, id as comment_id, parent as parent_id, node->'account'->>'name' as account, node->>'time' as time, coalesce(node->>'text', node->>'body') as text from comments""",
    "p2_redirects": "select distinct content_id, r.hop as hop, r.url as url, r.code as code from (select content_id, unnest(url_check.redirects) as r from content) where coalesce(r.url, '') <> ''",
}
