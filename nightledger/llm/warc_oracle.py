"""SQL for the digests of the WARC derivatives of pages."""

_UUID = "'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>'"

SQL = r"""
WITH visible AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl,
           regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis') AS page
    FROM pages),
texts AS (
    SELECT *, regexp_extract_all(page, '<a\s[^>]*?\bhref="([^"]*)"', 1) AS hrefs,
           regexp_replace(regexp_replace(page, '</?(?:article|body|br|div|h1|h2|h3|head|html|li|nav|p|pre|table|td|th|title|tr|ul|ol|footer|header|section)\b[^>]*>', chr(10), 'gi'),
                          '</?[A-Za-z!?][^>]*>', '', 'g') AS bare
    FROM visible),
plain AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&#39;', ''''), '&nbsp;', chr(160)),
                  '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS resolved
    FROM texts),
ids AS (
    SELECT *, trim(regexp_replace(regexp_replace(resolved, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n[\n ]*', chr(10), 'g'), ' ' || chr(10)) AS text, 'sha256:' || sha256(html) AS payload
    FROM plain),
hashed AS (SELECT *, sha256('response' || chr(10) || page_id || chr(10) || url || chr(10) || payload) AS h FROM ids),
named AS (SELECT *, RESPONSE AS response FROM hashed),
linked AS (
    SELECT *, sha256('metadata' || chr(10) || response) AS hm, sha256('conversion' || chr(10) || response) AS hc,
           'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html AS block
    FROM named)
SELECT page_id, response AS refers_to, url AS target_uri, METADATA AS metadata_id, CONVERSION AS conversion_id, payload AS payload_digest,
       'sha256:' || sha256(text) AS text_digest, strlen(text) AS n_text, len(hrefs) AS n_links,
       'sha256:' || sha256('source-payload-digest: ' || payload || nl || 'source-block-digest: sha256:' || sha256(block) || nl || 'http-status: HTTP/1.1 200 OK' || nl
           || 'http-header: Content-Type: text/html; charset=utf-8' || nl || 'http-header: Content-Length: ' || strlen(html) || nl
           || array_to_string(list_transform(hrefs, lambda x: 'outlink: ' || regexp_replace(x, '&amp;?', '&', 'g') || nl), '')) AS metadata_digest
FROM linked""".replace("RESPONSE", _UUID.format(h="h")).replace("METADATA", _UUID.format(h="hm")).replace("CONVERSION", _UUID.format(h="hc"))
