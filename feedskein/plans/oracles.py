"""SQL that gives the same result as each registered query, over the same tables.

None of it reads generated documents: what the parsers and the discovery should find is
stated from the tables the documents were generated from.
"""

SQL = {}


def oracle(name, body, *views):
    text = ""
    if views:
        text = "WITH " + ",\n".join(dict.fromkeys(v for group in views for v in group)) + "\n"
    SQL[name] = text + body


FEEDS = ["""feeds AS (
  SELECT c_custkey AS feed_id, c_name AS title,
         'https://feeds.example.com/' || c_custkey || '/feed.xml' AS url,
         'https://feeds.example.com/' || c_custkey AS link
  FROM customer)"""]

OBSERVATIONS = ["""observations AS (
  SELECT user_id AS feed_id, props AS guid, event_type || ' ' || event_id AS title,
         'https://feeds.example.com/' || user_id || '/' || event_id AS link,
         CASE WHEN event_type <> 'signup' THEN 'author of ' || event_type END AS author,
         CASE WHEN event_type <> 'error' THEN ts END AS published,
         CASE WHEN event_type = 'purchase' THEN '' ELSE '<p>' || props || '</p>' END AS summary,
         ts AS fetched_at, event_id AS pos, event_type,
         CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS history_guid
  FROM events)"""]

FIRST = [*OBSERVATIONS, """first_seen AS (
  SELECT * FROM observations
  QUALIFY row_number() OVER (PARTITION BY feed_id, guid ORDER BY fetched_at, pos) = 1)"""]

ARTICLES = [*FIRST, """articles AS (
  SELECT feed_id, guid, title, link, author, published, summary,
         event_type IN ('view', 'click') AS is_read, event_type = 'purchase' AS is_favorite
  FROM first_seen)"""]

LISTED = [*FEEDS, *ARTICLES, """listed AS (
  SELECT a.*, f.title AS feed_title FROM articles a JOIN feeds f USING (feed_id))"""]

UNREAD = [*FEEDS, *ARTICLES, """unread AS (
  SELECT feeds.*, coalesce(n, 0) AS unread_count
  FROM feeds LEFT JOIN (SELECT feed_id, count(*) AS n FROM articles WHERE NOT is_read GROUP BY feed_id) USING (feed_id))"""]

STATE_ARTICLES = [*OBSERVATIONS, """state_articles AS (
  SELECT feed_id, history_guid AS guid, title, link, author, published, summary,
         event_type IN ('view', 'click') AS is_read,
         event_type IN ('click', 'purchase', 'error') AS is_favorite
  FROM observations
  QUALIFY row_number() OVER (PARTITION BY feed_id, history_guid ORDER BY fetched_at, pos) = 1)"""]

oracle("feed_list_unread", """SELECT feed_id, title, url, link, CAST(unread_count AS BIGINT) AS unread_count
FROM unread""", UNREAD)
oracle("articles_all", "SELECT * FROM listed", LISTED)
oracle("articles_all_top", "SELECT * FROM listed ORDER BY published DESC NULLS LAST, feed_id, guid LIMIT 50", LISTED)
oracle("articles_next_page", "SELECT * FROM listed ORDER BY published DESC NULLS LAST, feed_id, guid LIMIT 50 OFFSET 50", LISTED)
oracle("articles_newest_per_feed", """SELECT *, row_number() OVER (
  PARTITION BY feed_id ORDER BY published DESC NULLS LAST, guid) AS rank FROM listed QUALIFY rank <= 3""", LISTED)
oracle("articles_by_feed", "SELECT * FROM listed WHERE feed_id = 7", LISTED)
oracle("articles_unread", "SELECT * FROM listed WHERE NOT is_read", LISTED)
oracle("articles_favorites", "SELECT * FROM listed WHERE is_favorite", LISTED)
oracle("articles_unread_favorites", """SELECT a.*, f.title AS feed_title
FROM state_articles a JOIN feeds f USING (feed_id) WHERE NOT is_read AND is_favorite""", FEEDS, STATE_ARTICLES)
oracle("article_rows", """SELECT feed_id, guid,
  CASE WHEN is_read THEN ' ' ELSE '●' END AS unread, CASE WHEN is_favorite THEN '★' ELSE ' ' END AS star,
  feed_title AS feed, title, COALESCE(strftime(published, '%Y-%m-%d'), '') AS date
FROM listed""", LISTED)
oracle("feed_labels", """SELECT CAST(0 AS BIGINT) AS section, '' AS title, CAST(NULL AS BIGINT) AS feed_id, 'All Feeds' AS label
UNION ALL SELECT 1, '', NULL, '★ Favorites'
UNION ALL SELECT 2, title, feed_id, title || ' (' || CAST(unread_count AS BIGINT) || ')' FROM unread""", UNREAD)
DETAILS = """concat_ws(' | ', feed_title, author, strftime(published, '%Y-%m-%d %H:%M')) AS meta"""
oracle("detail_meta", f"""SELECT feed_id, guid, title, {DETAILS},
  CASE WHEN summary = '' THEN '(no content)' ELSE summary END AS body
FROM listed""", LISTED)
oracle("article_view", f"""SELECT feed_id, guid, title, {DETAILS},
  CASE WHEN summary = '' THEN '' ELSE guid || chr(10) END || 'See' || chr(10) || 'the' || chr(10)
    || 'original' || chr(10) || '&' AS text,
  '[1] theoriginal (' || link || ')' || chr(10) || '[2] /all (/all)' AS links
FROM listed""", LISTED)

oracle("ingest_dedup", "SELECT feed_id, guid, title, link, author, published, summary, pos FROM first_seen", FIRST)
oracle("ingest_new_only", """SELECT feed_id, guid, title, link, author, published, summary,
  false AS is_read, false AS is_favorite
FROM first_seen f
WHERE NOT EXISTS (SELECT 1 FROM observations o
  WHERE o.event_type = 'view' AND o.feed_id = f.feed_id AND o.guid = f.guid)""", FIRST)
SQL["ingest_filtered"] = SQL["ingest_new_only"]
oracle("ingest_rejects", """SELECT pos, feed_id, guid,
  CASE WHEN feed_id IS NULL THEN 'feed_id is null' WHEN event_type = 'error' THEN 'title is null'
       WHEN event_type = 'purchase' THEN 'summary is null'
       WHEN feed_id NOT IN (SELECT c_custkey FROM customer) THEN 'no such feed' END AS reject_reason
FROM (SELECT pos, guid, event_type, CASE WHEN event_type <> 'signup' THEN feed_id * 20 END AS feed_id FROM observations)""",
       OBSERVATIONS)

STATE = [*OBSERVATIONS, """log AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'toggle' WHEN 'error' THEN 'delete'
            ELSE 'observe' END AS action
  FROM observations)""", """cuts AS (
  SELECT *, MAX(CASE WHEN action = 'delete' THEN pos END) OVER (PARTITION BY feed_id, history_guid) AS cut FROM log)"""]
STATE_BODY = """births AS (
  SELECT *, MIN(CASE WHEN action = 'observe' AND {alive} THEN pos END) OVER (PARTITION BY feed_id, history_guid) AS born
  FROM cuts)"""
STATE_RESULT = """SELECT b.feed_id, b.history_guid AS guid, b.title, b.link, b.author, b.published, b.summary,
  EXISTS (SELECT 1 FROM log l WHERE l.feed_id = b.feed_id AND l.history_guid = b.history_guid
          AND l.action = 'read' AND l.pos > b.born) AS is_read,
  (SELECT COUNT(*) FROM log l WHERE l.feed_id = b.feed_id AND l.history_guid = b.history_guid
          AND l.action = 'toggle' AND l.pos > b.born) % 2 = 1 AS is_favorite
FROM births b WHERE b.pos = b.born"""
oracle("state_fold", STATE_RESULT, STATE, [STATE_BODY.format(alive="(cut IS NULL OR pos > cut)")])
SQL["state_from_segments"] = SQL["state_fold"]
oracle("state_fold_tombstones", STATE_RESULT + " AND (b.cut IS NULL OR b.cut < b.born)",
       STATE, [STATE_BODY.format(alive="true")])
oracle("actions_applied", """SELECT a.feed_id, a.guid, title, link, author, published, summary,
  a.is_read OR d.any_read AS is_read, a.is_favorite <> (d.toggles % 2 = 1) AS is_favorite
FROM state_articles a JOIN (
  SELECT feed_id, history_guid AS guid, bool_or(event_type = 'error') AS deleted, bool_or(event_type = 'view') AS any_read,
         COUNT(*) FILTER (WHERE event_type = 'click') AS toggles
  FROM observations GROUP BY ALL) d USING (feed_id, guid)
WHERE NOT d.deleted""", STATE_ARTICLES)

oracle("schema_migration", """SELECT feed_id, guid, title, link, author, published, summary, is_read, false AS is_favorite
FROM articles""", ARTICLES)
oracle("articles_table", "SELECT * FROM articles", ARTICLES)
oracle("articles_appended", """SELECT *, CAST(1 AS BIGINT) AS of_this_id, guid >= '8' AS is_later FROM articles""", ARTICLES)
oracle("article_ids", """SELECT COUNT(*) AS articles, CAST(101 AS BIGINT) AS lowest, COUNT(*) + 100 AS highest, COUNT(*) AS ids
FROM articles""", ARTICLES)

REQUESTS = ["""requests AS (
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN 'Order ' || o_orderkey END AS title,
         'https://feeds.example.com/' || (o_custkey * 2) || '/feed.xml' AS url,
         CASE WHEN o_orderstatus = 'F' THEN 'https://feeds.example.com/' || (o_custkey * 2) ELSE '' END AS link,
         o_orderkey AS seq
  FROM orders)""", """judged AS (
  SELECT title, url, link, seq,
    CASE WHEN title IS NULL THEN 'title is null'
         WHEN url IN (SELECT url FROM feeds) THEN 'url exists'
         WHEN seq > MIN(CASE WHEN title IS NOT NULL THEN seq END) OVER (PARTITION BY url) THEN 'url exists' END AS reject_reason
  FROM requests)"""]
oracle("feeds_added", "SELECT * FROM judged", FEEDS, REQUESTS)
oracle("feeds_table", """SELECT title, url, link, false AS is_new FROM feeds
UNION ALL SELECT title, url, link, true FROM judged WHERE reject_reason IS NULL""", FEEDS, REQUESTS)
oracle("feeds_readded", """SELECT title, url, link, false AS is_new, CAST(1 AS BIGINT) AS of_this_id
FROM feeds WHERE feed_id < (SELECT MAX(feed_id) FROM feeds)
UNION ALL SELECT title, url, link, true, 1 FROM judged WHERE reject_reason IS NULL""", FEEDS, REQUESTS)
oracle("feeds_url_exists", """SELECT DISTINCT url, url IN (SELECT url FROM feeds) AS subscribed FROM requests""",
       FEEDS, REQUESTS)

SELECTORS = ["""segment_feeds AS (
  SELECT c_custkey AS feed_id, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS title,
         'https://feeds.example.com/' || c_custkey AS url, '' AS link
  FROM customer)""", """selectors AS (
  SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_name WHEN 'BUILDING' THEN ' ' || c_custkey || ' '
         WHEN 'FURNITURE' THEN '+' || c_custkey WHEN 'HOUSEHOLD' THEN 'nobody ' || c_custkey
         ELSE CAST(c_custkey AS VARCHAR) END AS selector FROM customer
  UNION SELECT c_mktsegment FROM customer)""", """found AS (
  SELECT selector, COALESCE(
    (SELECT MIN(feed_id) FROM segment_feeds f WHERE f.title = s.selector),
    (SELECT MIN(feed_id) FROM segment_feeds f WHERE f.feed_id = TRY_CAST(replace(trim(s.selector), '+', '') AS BIGINT))) AS feed_id
  FROM selectors s)"""]
oracle("feeds_lookup", """SELECT s.selector, s.feed_id, f.title, f.url, f.link
FROM found s LEFT JOIN segment_feeds f USING (feed_id)""", SELECTORS)
oracle("feeds_removed_cascade", """SELECT feed_id, CAST(NULL AS VARCHAR) AS guid FROM segment_feeds
WHERE feed_id NOT IN (SELECT feed_id FROM found WHERE feed_id IS NOT NULL)
UNION ALL SELECT feed_id, guid FROM articles
WHERE feed_id NOT IN (SELECT feed_id FROM found WHERE feed_id IS NOT NULL)""", SELECTORS, ARTICLES)
SQL["feeds_removed_stored"] = SQL["feeds_removed_cascade"]
oracle("feeds_removed_outcome", "SELECT selector, feed_id, feed_id IS NOT NULL AS removed FROM found", SELECTORS)

DOCUMENTS = ["""docs AS (
  SELECT *, 'https://docs.example.com/' || doc_id || '/feed.xml' AS url, 'https://docs.example.com/' || doc_id AS site,
         CASE lang WHEN 'en' THEN 'rss' WHEN 'de' THEN 'atom' WHEN 'fr' THEN 'rdf' ELSE 'broken' END AS fmt,
         CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN CAST(substr(source, 4) AS INTEGER) ELSE 5 END AS kase
  FROM documents)""", """entry_rows AS (
  SELECT doc_id, url, kase, pos,
    CASE fmt WHEN 'atom' THEN url || '#' || pos WHEN 'rdf' THEN '' ELSE md5(line) END AS guid,
    CASE fmt WHEN 'rdf' THEN 'Untitled' ELSE 'Line ' || pos END AS title,
    CASE fmt WHEN 'rdf' THEN '' ELSE url || '#' || pos END AS link,
    CASE WHEN fmt <> 'rdf' THEN lang END AS author,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 87600) + to_minutes(pos)
      + to_hours(CASE fmt WHEN 'rdf' THEN -2 WHEN 'broken' THEN 5 ELSE 0 END) AS published,
    trim(line) AS summary
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM docs))"""]
ERROR = """CASE kase WHEN 0 THEN 'Timeout fetching ' || url WHEN 1 THEN 'HTTP 404 fetching ' || url
  WHEN 2 THEN 'Network error fetching ' || url || ': no such host' {more} END"""
FETCH_ERROR = ERROR.format(more="")
FEED_ERROR = ERROR.format(more="WHEN 3 THEN 'Malformed feed content from ' || url")
STATUS = "CAST(CASE WHEN kase = 1 THEN 404 WHEN kase > 2 THEN 200 END AS BIGINT) AS http_status"
ENTRY = "guid, title, link, author, published, summary"
TITLE = """CASE fmt WHEN 'rdf' THEN url WHEN 'broken' THEN source || ' & ' || doc_id || ' ©'
  ELSE source || ' & ' || doc_id END"""
LINK = "CASE fmt WHEN 'broken' THEN '' ELSE site END"

oracle("capture_outcomes", f"""SELECT url, {STATUS}, {FETCH_ERROR} AS error FROM docs
UNION ALL SELECT url, 500, 'HTTP 500 fetching ' || url FROM docs""", DOCUMENTS)
oracle("capture_files", f"""SELECT url, url AS final_url, {STATUS},
  CASE kase WHEN 0 THEN 'timeout' WHEN 2 THEN 'no such host' END AS error_kind, kase > 2 AS has_body,
  TIMESTAMP '2025-01-01 00:00:00' AS fetched_at FROM docs
UNION ALL SELECT url, url, 500, NULL, false, TIMESTAMP '2024-12-31 00:00:00' FROM docs""", DOCUMENTS)
SQL["capture_archives"] = SQL["capture_files"]
oracle("capture_latest", f"""SELECT url, {STATUS},
  CASE kase WHEN 0 THEN 'timeout' WHEN 2 THEN 'no such host' END AS error_kind FROM docs""", DOCUMENTS)
oracle("parse_entries", f"SELECT url, pos, {ENTRY} FROM entry_rows", DOCUMENTS)
SQL["parse_entries_in_parts"] = SQL["parse_entries"]
oracle("parse_articles", f"""SELECT pos, {ENTRY}, doc_id AS feed_id, false AS is_read, false AS is_favorite
FROM entry_rows""", DOCUMENTS)
oracle("parse_feed_info", f"""SELECT url, {TITLE} AS title, {LINK} AS link,
  CASE fmt WHEN 'atom' THEN 'atom' ELSE 'rss' END AS feed_type FROM docs""", DOCUMENTS)
oracle("parse_rejects", f"""SELECT url, {STATUS}, {FEED_ERROR} AS error FROM docs
UNION ALL SELECT url, 500, 'HTTP 500 fetching ' || url FROM docs""", DOCUMENTS)
SQL["parse_rejects_in_parts"] = SQL["parse_rejects"]
oracle("fetch_and_parse", f"""SELECT url, {FEED_ERROR} AS error,
  CASE WHEN kase > 4 THEN len(string_split(text, chr(10))) ELSE 0 END AS entries FROM docs
UNION ALL SELECT site || '/gone.xml', 'Network error fetching ' || site || '/gone.xml: not captured', 0 FROM docs""", DOCUMENTS)
oracle("fetch_redirected", f"""SELECT url, {FEED_ERROR} AS error,
  CASE WHEN kase > 4 THEN len(string_split(text, chr(10))) ELSE 0 END AS entries
FROM (SELECT * REPLACE ('https://old.example.com/' || doc_id AS url) FROM docs)""", DOCUMENTS)
oracle("redirects_followed", """WITH RECURSIVE placed AS (
  SELECT c_custkey AS k, c_custkey % 32 AS place, c_custkey // 32 % 4 AS run FROM customer),
captured AS (
  SELECT CASE WHEN place = 0 AND run = 2 THEN 'https://alias.example.com/' || k ELSE 'https://r.example.com/' || k END AS url,
    'https://r.example.com/' || CASE WHEN place = 0 THEN k WHEN place = 5 AND run = 3 THEN k + 3 ELSE k - 1 END AS final_url,
    CASE WHEN place > 0 THEN 301 WHEN run = 1 THEN 404 ELSE 200 END AS http_status,
    CASE WHEN place = 0 AND run <> 1 THEN 'document ' || k END AS body FROM placed),
walked(url, last, hops) AS (
  SELECT url, final_url, 1 FROM captured WHERE http_status = 301
  UNION ALL
  SELECT w.url, c.final_url, hops + 1 FROM walked w JOIN captured c ON c.url = w.last
  WHERE c.http_status = 301 AND hops <= 20),
ends AS (SELECT url, arg_max(last, hops) AS last, max(hops) AS hops FROM walked GROUP BY url),
documents_at AS (
  SELECT url, http_status, body FROM captured WHERE http_status <> 301
  UNION ALL SELECT final_url, http_status, body FROM captured
  WHERE http_status = 200 AND url <> final_url AND final_url NOT IN (SELECT url FROM captured))
SELECT url, final_url, http_status::BIGINT AS http_status, NULL::VARCHAR AS error_kind, body FROM captured WHERE http_status <> 301
UNION ALL SELECT d.url, d.url, http_status, NULL, body FROM documents_at d WHERE url NOT IN (SELECT url FROM captured)
UNION ALL SELECT e.url, e.last, d.http_status, CASE WHEN d.url IS NULL THEN 'not captured' END, d.body
  FROM ends e LEFT JOIN documents_at d ON d.url = e.last WHERE hops <= 20
UNION ALL SELECT e.url, c.final_url, NULL, 'Exceeded maximum allowed redirects.', NULL
  FROM ends e JOIN captured c USING (url) WHERE hops > 20""")
oracle("feed_types", "SELECT doc_id, CASE lang WHEN 'de' THEN 'atom' ELSE 'rss' END AS feed_type FROM documents")
oracle("parse_dates", """SELECT event_id, CASE event_type
  WHEN 'view' THEN s WHEN 'click' THEN s + INTERVAL 5 HOUR WHEN 'purchase' THEN s - INTERVAL 2 HOUR
  WHEN 'signup' THEN s ELSE CASE WHEN value < 20 THEN CAST(CAST(s AS DATE) AS TIMESTAMP) END END AS published
FROM (SELECT event_id, event_type, value, date_trunc('second', ts) AS s FROM events)""")

NEW = [*DOCUMENTS, """live AS (
  SELECT DISTINCT doc_id, guid FROM (
    SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS guid FROM documents) WHERE guid < '8')""",
       """seen AS (
  SELECT * FROM entry_rows WHERE kase > 4
  QUALIFY row_number() OVER (PARTITION BY doc_id, guid ORDER BY pos) = 1)""", """fresh AS (
  SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.doc_id = s.doc_id AND l.guid = s.guid))""",
       f"""report AS (
  SELECT d.doc_id AS feed_id, d.lang, COUNT(f.guid) AS new_articles, {FEED_ERROR.replace('url', 'd.url').replace('kase', 'd.kase')} AS error
  FROM docs d LEFT JOIN fresh f ON d.doc_id = f.doc_id GROUP BY d.doc_id, d.lang, d.url, d.kase)"""]
oracle("refresh_articles", f"SELECT doc_id AS feed_id, {ENTRY}, pos FROM fresh", NEW)
oracle("refresh_report", "SELECT feed_id, new_articles, error FROM report", NEW)
oracle("refresh_one", "SELECT feed_id, new_articles, error FROM report WHERE lang IN ('fr', 'de')", NEW)
oracle("refresh_summary", """SELECT feeds, new_articles, failed_feeds, 'Fetched ' || new_articles || ' new article(s)'
  || CASE WHEN failed_feeds > 0 THEN ' (' || failed_feeds || ' feed(s) failed)' ELSE '' END AS message
FROM (SELECT COUNT(*) AS feeds, CAST(SUM(new_articles) AS BIGINT) AS new_articles, COUNT(error) AS failed_feeds FROM report)""", NEW)
oracle("refresh_feed_info", f"""SELECT doc_id AS feed_id,
  CASE WHEN kase > 4 THEN {TITLE} WHEN kase = 4 THEN 'Nothing yet' ELSE 'Feed ' || doc_id END AS title, url,
  CASE WHEN kase > 4 THEN {LINK} ELSE '' END AS link FROM docs""", DOCUMENTS)
oracle("refresh_stream", f"""SELECT doc_id AS feed_id, {ENTRY}, false AS is_read, false AS is_favorite FROM seen""", NEW)

ACTED = [*NEW, """acted AS (
  SELECT doc_id, md5(string_split(text, chr(10))[1]) AS guid, source FROM documents)""", f"""streamed AS (
  SELECT doc_id AS feed_id, {ENTRY}, false AS is_read, false AS is_favorite FROM seen s
  WHERE NOT EXISTS (SELECT 1 FROM acted a WHERE a.doc_id = s.doc_id AND a.guid = s.guid)
  UNION ALL
  SELECT doc_id, guid, 'Later', guid, NULL, NULL, '', true, false FROM acted WHERE source = 'src7')"""]
oracle("refresh_stream_actions", "SELECT * FROM streamed", ACTED)
oracle("stored_after_removal", """SELECT * FROM streamed
WHERE feed_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""", ACTED)

oracle("keyed_articles", "SELECT * FROM streamed", ACTED)
DOCUMENT_FEEDS = ["""document_feeds AS (
  SELECT doc_id AS feed_id, 'Feed ' || doc_id AS title, 'https://docs.example.com/' || doc_id || '/feed.xml' AS url, '' AS link
  FROM documents)"""]
oracle("keyed_feed_list", """SELECT f.feed_id, f.title, f.url, f.link, COALESCE(unread, 0) AS unread_count
FROM document_feeds f LEFT JOIN (
  SELECT feed_id, COUNT(*) FILTER (NOT is_read) AS unread FROM streamed GROUP BY feed_id) USING (feed_id)
WHERE f.feed_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""", ACTED, DOCUMENT_FEEDS)

# --- pages ---

ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
oracle("page_links", f"""SELECT page_id, pos, text, href, {ROOT} || href AS resolved_href,
  '[' || (pos + 1) || '] ' || text || ' (' || href || ')' AS line
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
             unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
             CAST(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'), 1) - 1 AS BIGINT) AS pos
      FROM pages)""")
oracle("page_text", r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(
    regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', chr(1), 'gs'), chr(1)),
    lambda x: regexp_replace(regexp_replace(
      replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
      '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text
FROM pages""")

SITE = [f"""site_pages AS (
  SELECT page_id, url, {ROOT} AS root, html,
         CASE WHEN contains(url, '?page=') THEN 'two' WHEN contains(url, '.html') THEN 'one'
              WHEN contains(url, '#top') THEN 'down' WHEN contains(url, 'utm_source') THEN 'feed' ELSE 'none' END AS kind,
         regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') AS folder FROM pages)""", """homes AS (
  SELECT root, MIN(page_id) AS home_id, arg_min(html, page_id) AS html FROM site_pages GROUP BY root)""", """tag_feeds AS (
  SELECT page_id, url AS site_url, CAST(0 AS BIGINT) AS pos, root || '/p/' || page_id || '/rss' AS url,
         'RSS ' || page_id AS title, 'rss' AS feed_type FROM site_pages WHERE kind IN ('one', 'two')
  UNION ALL
  SELECT page_id, url, 1, folder || 'atom.xml', folder || 'atom.xml', 'atom' FROM site_pages WHERE kind = 'two')""",
        """path_feeds AS (
  SELECT root, CAST(pos AS BIGINT) AS pos, root || path AS url, title, feed_type, home_id
  FROM homes, (VALUES (0, '/feed', 'Site feed', 'rss'), (2, '/atom.xml', 'Site feed, Atom', 'atom')) p(pos, path, title, feed_type)
  WHERE contains(root, '://m.'))""", """map_locs AS (
  SELECT root, url, CAST(MIN(pos) AS BIGINT) AS pos FROM (
    SELECT root, unnest(locs) AS loc, generate_subscripts(locs, 1) - 1 AS pos, root || unnest(locs) AS url
    FROM (SELECT root, list_concat(regexp_extract_all(html, '<a href="([^"]+)"', 1),
            ['/feedback', '/news/feed.xml', '/x?y=/rss', '/News/FEED.xml', '/news/feed.xml', '/a/atom']) AS locs
          FROM homes WHERE contains(root, '://blog.') OR contains(root, '://www.')))
  WHERE regexp_matches(lower(split_part(split_part(loc, '#', 1), '?', 1)), '/feed|/rss|/atom') GROUP BY root, url)""",
        """map_feeds AS (
  SELECT l.*, CASE WHEN url = root || '/a/atom' THEN 'Notes' ELSE 'News' END AS title,
         CASE WHEN url = root || '/a/atom' THEN 'atom' ELSE 'rss' END AS feed_type
  FROM map_locs l WHERE url IN (root || '/news/feed.xml', root || '/a/atom'))"""]
RANK = "row_number() OVER (PARTITION BY {by} ORDER BY feed_type <> 'atom', title, pos) AS rank"
COLUMNS = "pos, url, title, feed_type"

oracle("page_captures", """SELECT url AS site_url, CASE WHEN kind = 'down' THEN NULL
  WHEN kind = 'feed' THEN '<rss version="2.0"><channel><title>Page ' || page_id || '</title></channel></rss>'
  ELSE replace(html, '</head>',
    '<link rel="stylesheet" type="text/css" href="/s.css"><link rel="alternate" type="application/rss+xml">'
    || CASE WHEN kind IN ('one', 'two') THEN '<link rel="alternate" type="application/rss+xml" title="RSS ' || page_id
         || '" href="/p/' || page_id || '/rss">' ELSE '' END
    || CASE WHEN kind = 'two' THEN '<LINK REL="home alternate" TYPE="Application/Atom+XML" HREF="atom.xml">' ELSE '' END
    || '</head>') END AS html
FROM site_pages""", SITE)
oracle("discover_link_tags", f"SELECT page_id, {COLUMNS} FROM tag_feeds", SITE)
oracle("discover_well_known", f"SELECT root, {COLUMNS}, {RANK.format(by='root')} FROM path_feeds", SITE)
oracle("validate_candidates", "SELECT root, pos, url FROM path_feeds", SITE)
oracle("discover_sitemap", f"SELECT root, {COLUMNS}, {RANK.format(by='root')} FROM map_feeds", SITE)
oracle("sitemap_candidates", "SELECT root, pos, url FROM map_locs", SITE)
SQL["sitemap_candidates_in_parts"] = SQL["sitemap_candidates"]

DISCOVERED = [*SITE, f"""found_feeds AS (
  SELECT t.site_url, 'link_tags' AS strategy, {', '.join('t.' + c.strip() for c in COLUMNS.split(','))}
  FROM tag_feeds t JOIN site_pages p USING (page_id)
  UNION ALL
  SELECT p.url, 'well_known', f.pos, f.url, f.title, f.feed_type FROM site_pages p JOIN path_feeds f USING (root)
  WHERE p.kind IN ('down', 'none')
  UNION ALL
  SELECT p.url, 'sitemap', f.pos, f.url, f.title, f.feed_type FROM site_pages p JOIN map_feeds f USING (root)
  WHERE p.kind IN ('down', 'none'))""", f"""ranked AS (
  SELECT *, {RANK.format(by='site_url')} FROM found_feeds)""", """resolved AS (
  SELECT p.url AS site_url, p.root,
    CASE WHEN p.kind = 'feed' THEN 1 ELSE (SELECT COUNT(*) FROM ranked r WHERE r.site_url = p.url) END AS found,
    CASE WHEN p.kind = 'feed' THEN 'direct' ELSE (SELECT CASE COUNT(*) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multiple' END
      FROM ranked r WHERE r.site_url = p.url) END AS outcome,
    CASE WHEN p.kind = 'feed' THEN p.url ELSE b.url END AS feed_url,
    CASE WHEN p.kind = 'feed' THEN 'Page ' || p.page_id ELSE b.title END AS title
  FROM site_pages p LEFT JOIN ranked b ON b.site_url = p.url AND b.rank = 1)"""]
oracle("discover_fallback", "SELECT * FROM ranked", DISCOVERED)
oracle("resolve_outcome", "SELECT site_url, outcome, CAST(found AS BIGINT) AS found, feed_url, title FROM resolved", DISCOVERED)


def subscribed(name, takes):
    known = """known_feeds AS (SELECT root || '/atom.xml' AS url FROM homes WHERE contains(root, '-'))"""
    good = """good_feeds AS (
  SELECT url, 'Page ' || page_id AS title FROM site_pages WHERE kind = 'feed'
  UNION ALL SELECT url, 'Linked ' || page_id FROM tag_feeds WHERE pos = 0 AND contains(site_url, '/en/')
  UNION ALL SELECT url, title FROM path_feeds UNION ALL SELECT url, title FROM map_feeds)"""
    bad = """bad_feeds AS (SELECT url FROM tag_feeds WHERE pos = 0 AND NOT contains(site_url, '/en/'))"""
    checked = f"""checked AS (
  SELECT r.site_url, r.outcome, r.found, CASE WHEN taken THEN r.feed_url END AS feed_url, taken,
    k.url IS NOT NULL AND taken AS known, g.title AS feed_title,
    CASE WHEN b.url IS NOT NULL THEN 'Malformed feed content from ' || r.feed_url
         WHEN g.url IS NULL THEN 'Network error fetching ' || r.feed_url || ': not captured' END AS error
  FROM (SELECT *, outcome IN ({takes}) AS taken FROM resolved) r
  LEFT JOIN known_feeds k ON k.url = r.feed_url LEFT JOIN good_feeds g ON g.url = r.feed_url
  LEFT JOIN bad_feeds b ON b.url = r.feed_url)"""
    judged = """judged_sites AS (
  SELECT *, CASE WHEN outcome = 'none' THEN 'not_found' WHEN NOT taken THEN 'choose' WHEN known THEN 'exists'
    WHEN error IS NOT NULL THEN 'error'
    WHEN site_url > MIN(site_url) OVER (PARTITION BY feed_url) THEN 'exists' ELSE 'added' END AS status FROM checked)"""
    oracle(name, """SELECT site_url, outcome, status, feed_url,
  CASE WHEN status = 'added' THEN feed_title END AS title, CASE WHEN status = 'added' THEN '' END AS link,
  CASE status WHEN 'added' THEN feed_title WHEN 'exists' THEN 'Error: Already subscribed to ' || feed_url
    WHEN 'error' THEN 'Error: ' || error WHEN 'choose' THEN found || ' feeds found'
    ELSE 'No RSS or Atom feeds found at ' || site_url || '. Try a direct feed URL.' END AS message
FROM judged_sites""", DISCOVERED, [known, good, bad, checked, judged])


subscribed("subscriptions", "'direct', 'single'")
subscribed("subscriptions_first", "'direct', 'single', 'multiple'")
