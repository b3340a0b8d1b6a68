"""Documentation sources as queries: examples, references, includes, procedures, over files made of the documents' ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import directives, rst
from pagequarry.functions import scalars as S
from pagequarry.operators import graph, includes, ingest, paths
from pagequarry.plans import fixtures as X
from pagequarry.plans.registry import query
from pagequarry.sources import sinks

#: A page, {k} its number, {a} {b} {c} what files it includes, one a line.
PAGE = """Heading {k}
==================

.. include:: /includes/i{a}.rst

.. code-block:: js
   :copyable: true

   let x = {k};
     y

.. literalinclude:: /includes/c{b}.py
   :language: python
   :start-after: start
   :end-before: end
   :dedent:

.. io-code-block::

   .. input::
      :language: sh

      run {k}

   .. output:: /out{b}.json

.. output:: /stray.json

.. toctree::
   :maxdepth: 1

   /t{c}
   Home </index>

Steps
-----

1. One {b}
#. Two

   .. include:: /includes/steps/s{b}.rst
"""
#: Files that pages include: i0 to i6 (even ones a procedure, odd ones the next file's content), c0 to c2, step files,
#: and extracts by reference; x1 and x2 include each other.
SHARED = {
    **{f"includes/i{a}.rst": f".. procedure::\n\n   .. step:: S{a}\n\n      Text" if a % 2 == 0 else f"before {a}\n\n.. include:: /includes/i{a + 1}.rst" for a in range(7)},
    **{f"includes/c{b}.py": f"import x\n# start\n    part {b}\n      more\n    # end\n" for b in range(3)},
    **{f"includes/steps-s{b}.yaml": f"title: From YAML {b}\nref: r{b}\npre: |\n  before\n---\ntitle: Last\n" for b in range(3)},
    "includes/extracts-all.yaml": "ref: e0\ncontent: x\n---\nref: 'e1'\ncontent: y\n",
    "includes/x1.rst": "one\n.. include:: /includes/x2.rst\nend",
    "includes/x2.rst": "two\n.. include:: /includes/x1.rst",
}
ROOT = "content/p/source/"


def _pages(spark, sf_dir, every: int = 1):
    k = F.col("doc_id")
    content = F.lit(PAGE)
    for name, value in (("k", k), ("a", k % 7), ("b", k % 3), ("c", k % 11)):
        content = F.replace(content, F.lit("{" + name + "}"), value.cast("string"))
    return X.table(spark, sf_dir, "documents").where(k % every == 0).select(F.concat(F.lit(ROOT + "f"), k.cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))


def _shared(spark):
    return spark.createDataFrame([(ROOT + p, c) for p, c in SHARED.items()], "path string, content string")


def _files(spark, sf_dir):
    return _pages(spark, sf_dir).unionByName(_shared(spark))


DOCS = f"WITH d AS (SELECT doc_id AS k, doc_id % 7 AS a, doc_id % 3 AS b, doc_id % 11 AS c, '{ROOT}f' || doc_id || '.txt' AS path FROM documents)"


@query(DOCS + " SELECT path, 'code-block' AS directive, 1 AS index, '' AS sub, 'js' AS language, 'let x = ' || k || ';' || chr(10) || '  y' AS content FROM d UNION ALL SELECT path, 'literalinclude', 1, '', 'python', 'part ' || b || chr(10) || '  more' FROM d UNION ALL SELECT path, 'io-code-block', 1, 'input', 'sh', 'run ' || k FROM d")
def code_examples(spark, sf_dir):
    """Examples of all pages with what they include; an output that names a file is passed over."""
    found = ingest.included_examples(directives.example_table(_pages(spark, sf_dir)), _files(spark, sf_dir))
    return found.select("path", "directive", "index", "sub", "language", "content")


@query(DOCS + " SELECT 'f' || k || '.code-block.1.js' AS path, length('let x = ' || k || ';') + 4 AS bytes FROM d UNION ALL SELECT 'f' || k || '.literalinclude.1.py', 13 FROM d UNION ALL SELECT 'f' || k || '.io-code-block.1.input.sh', length('run ' || k) FROM d")
def example_files(spark, sf_dir):
    """The files that the examples would be written to."""
    return sinks.write_files(ingest.example_files(code_examples(spark, sf_dir)), "file:///nowhere", dry_run=True)


REFS = "SELECT path AS source, 'include' AS directive, '/includes/i' || a || '.rst' AS ref, 4 AS line FROM d UNION ALL SELECT path, 'literalinclude', '/includes/c' || b || '.py', 12 FROM d UNION ALL SELECT path, 'io-code-block', '/out' || b || '.json', 25 FROM d UNION ALL SELECT path, 'toctree', '/t' || c, 32 FROM d UNION ALL SELECT path, 'toctree', '/index', 33 FROM d UNION ALL SELECT path, 'include', '/includes/steps/s' || b || '.rst', 41 FROM d"


@query(DOCS + " " + REFS)
def reference_edges(spark, sf_dir):
    """An output outside of an io-code-block is no reference."""
    return directives.edge_table(_pages(spark, sf_dir))


@query(DOCS + f", r AS ({REFS}) SELECT source, ref, CASE WHEN ref LIKE '/includes/steps/%' THEN '{ROOT}includes/steps-s' || right(split_part(ref, '.', 1), 1) || '.yaml' WHEN ref LIKE '/includes/%' THEN '{ROOT}' || substr(ref, 2) WHEN ref LIKE '/t%' AND CAST(substr(ref, 3) AS INTEGER) = 5 THEN '{ROOT}t5.txt' END AS target FROM r")
def resolved_references(spark, sf_dir):
    files = _files(spark, sf_dir).unionByName(spark.createDataFrame([(ROOT + "t5.txt", "x")], "path string, content string"))
    return includes.resolve_includes(directives.edge_table(_pages(spark, sf_dir)).select("source", "ref"), files)


@query(f"SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN '{ROOT}includes/extracts-all.yaml' WHEN 1 THEN '{ROOT}includes/i1.rst' WHEN 2 THEN '{ROOT}includes/c2.py' END AS target FROM documents")
def indirect_references(spark, sf_dir):
    """References by entry, by template variable, from the file's own folder, and to nothing."""
    k = F.col("doc_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("/includes/extracts/e"), (k % 8 / 4).cast("int").cast("string"), F.lit(".rst"))).when(k % 4 == 1, "{{ one }}").when(k % 4 == 2, "c2.py").otherwise("/nothing")
    own = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(ROOT + "includes/own"), k.cast("string"), F.lit(".rst")).alias("path"), ref.alias("ref"))
    variables = own.select("path", F.lit('ref: x\nreplacement:\n  other: "no"\n  one: "/includes/i1.rst"\n').alias("content"))
    found = includes.resolve_includes(own.select(F.col("path").alias("source"), "ref"), _shared(spark).unionByName(variables))
    return found.join(own.select(F.col("path").alias("source"), F.col("doc_id").alias("k")), "source").select("k", "target")


@query()
def expanded_pages(spark, sf_dir):
    """Includes put in place, to any depth, step files as procedures. tests/test_trees.py expands the same files plainly."""
    return includes.expand_includes(_files(spark, sf_dir), _pages(spark, sf_dir).select("path"))


@query(DOCS + ", p AS (SELECT path, 'directive' AS kind, 'Heading ' || k AS title, CAST(CASE WHEN a % 2 = 0 THEN 4 ELSE 6 END AS INTEGER) AS line, 1 AS steps FROM d UNION ALL SELECT path, 'ordered-list', 'Steps', CASE WHEN a % 2 = 0 THEN 42 ELSE 44 END, 2 FROM d) SELECT path, kind, title, line, steps FROM p")
def procedures(spark, sf_dir):
    """Procedures of pages whose includes are expanded."""
    expanded = includes.expand_includes(_files(spark, sf_dir), _pages(spark, sf_dir).select("path"))
    return rst.procedure_table(expanded).select("path", "kind", "title", "line", "steps")


#: Three kinds by {kind}: a tab set, a composable tutorial whose two selections share their procedure, numbered headings.
GROUPED = {
    0: "Install {k}\n==================\n\n.. tabs::\n\n   .. tab:: Two\n      :tabid: win\n\n      .. procedure::\n\n         .. step:: W\n\n            a. x\n            b. y\n\n   .. tab:: One\n      :tabid: mac\n\n      .. procedure::\n\n         .. step:: M\n         .. step:: N\n\nAfter.\n",
    1: "Connect {k}\n==================\n\n.. composable-tutorial::\n   :options: lang\n   :defaults: py\n\n   .. selected-content::\n      :selections: py, atlas\n\n      .. procedure::\n\n         .. step:: Same\n\n   .. selected-content::\n      :selections: js\n\n      .. procedure::\n\n         .. step:: Same\n\n      .. procedure::\n\n         .. step:: Other\n",
    2: "Title {k}\n==================\n\nProcedure\n---------\n\n1. First\n~~~~~~~~\n\nText.\n\n2. Second\n~~~~~~~~~\n\na. sub\nb. sub\n\n3. Third\n~~~~~~~~\n",
    3: "Tabs {k}\n==================\n\n.. procedure::\n\n   .. step:: A\n\n      .. tabs::\n\n         .. tab:: x\n            :tabid: t2\n\n            in t2\n\n         .. tab:: y\n            :tabid: t1\n\n            in t1\n\n      General.\n",
}


def _grouped(spark, sf_dir):
    k = F.col("doc_id")
    content = F.lit(GROUPED[0])
    for i in (1, 2, 3):
        content = F.when(k % 4 == i, F.lit(GROUPED[i])).otherwise(content)
    return X.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.replace(content, F.lit("{k}"), k.cast("string")).alias("content"))


VARIED = """WITH d AS (SELECT doc_id AS k, doc_id % 4 AS i, 'f' || doc_id AS path FROM documents),
p AS (SELECT path, 'directive' AS kind, 'Install ' || k AS title, 4 AS line, v.steps, v.subs AS n_subs, v.id AS variations FROM d, (VALUES ('mac', 2, 0), ('win', 1, 1)) v(id, steps, subs) WHERE i = 0
 UNION ALL SELECT path, 'tutorial', 'Connect ' || k, 4, 1, 0, v.id FROM d, (VALUES ('py, atlas;js'), ('js')) v(id) WHERE i = 1
 UNION ALL SELECT path, 'headings', 'Procedure', 4, 3, 1, '' FROM d WHERE i = 2 UNION ALL SELECT path, 'directive', 'Tabs ' || k, 4, 1, 0, 't1;t2' FROM d WHERE i = 3)"""


@query(VARIED + " SELECT * FROM p")
def procedure_variations(spark, sf_dir):
    found = rst.procedure_table(_grouped(spark, sf_dir))
    return found.select("path", "kind", "title", "line", "steps", "n_subs", F.array_join("variations", ";").alias("variations"))


@query(VARIED + ", g AS (SELECT kind, path, sum(len(string_split(variations, ';'))) AS n FROM p WHERE kind <> 'tutorial' GROUP BY ALL UNION ALL SELECT kind, path, len(string_split(variations, ';')) FROM p WHERE kind = 'tutorial'), t AS (SELECT kind, path, sum(n) AS n FROM g GROUP BY ALL) SELECT kind, CAST(count(*) AS BIGINT) AS procedures, CAST(sum(n) AS BIGINT) AS variations FROM t GROUP BY ROLLUP (kind)")
def procedure_totals(spark, sf_dir):
    """The procedures of a tab set or a tutorial count as one."""
    return ingest.procedure_totals(rst.procedure_table(_grouped(spark, sf_dir)))


@query(VARIED + " SELECT path, title, CAST(count(*) AS BIGINT) AS procedures, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(len(string_split(variations, ';'))) AS BIGINT) AS variations FROM p GROUP BY ALL")
def procedures_by_heading(spark, sf_dir):
    return ingest.procedures_by_heading(rst.procedure_table(_grouped(spark, sf_dir)))


@query(VARIED + " SELECT path, variations FROM p WHERE list_contains(string_split(variations, ';'), 'js')")
def procedures_of_selection(spark, sf_dir):
    found = ingest.procedures_of_selection(rst.procedure_table(_grouped(spark, sf_dir)), "js")
    return found.select("path", F.array_join("variations", ";").alias("variations"))


@query(VARIED + " SELECT path, title, string_agg(v, ';' ORDER BY v) AS variations FROM (SELECT path, title, steps, n_subs, line, kind, variations AS whole, unnest(string_split(variations, ';')) AS v FROM p) GROUP BY path, title, steps, n_subs, whole")
def distinct_procedures(spark, sf_dir):
    return ingest.distinct_procedures(rst.procedure_table(_grouped(spark, sf_dir))).select("path", "title", F.array_join("variations", ";").alias("variations"))


@query("WITH d AS (SELECT doc_id AS k FROM documents WHERE doc_id % 4 = 3), v(t) AS (VALUES ('t1'), ('t2')) SELECT 'f' || k AS path, t AS variation, 'Tabs ' || k || chr(10) || repeat('=', length('Tabs ' || k)) || chr(10) || chr(10) || '.. procedure::' || chr(10) || chr(10) || '   .. step:: A' || chr(10) || chr(10) || '      General.' || chr(10) || chr(10) || '      in ' || t || chr(10) AS content FROM d, v")
def procedure_texts(spark, sf_dir):
    """A procedure as text, once for each of its variations."""
    return rst.procedure_texts(_grouped(spark, sf_dir).where(F.substring("path", 2, 20).cast("long") % 4 == 3)).select("path", "variation", "content")


@query("WITH d AS (SELECT doc_id AS k FROM documents WHERE doc_id % 4 = 3), v(t) AS (VALUES ('t1'), ('t2')) SELECT 'tabs-' || k || '-' || t AS name FROM d, v")
def procedure_files(spark, sf_dir):
    texts = rst.procedure_texts(_grouped(spark, sf_dir).where(F.substring("path", 2, 20).cast("long") % 4 == 3))
    return ingest.procedure_files(texts).select(F.regexp_replace("path", r"-[0-9a-f]{6}\.rst$", "").alias("name"))


@query("SELECT 'steps-' || doc_id || '.yaml' AS path, '.. procedure::' || chr(10) || '   :style: normal' || chr(10) || chr(10) || '   .. step:: First ' || doc_id || chr(10) || chr(10) || '      go' || chr(10) || '        on' || chr(10) || chr(10) || '      (Action content from YAML)' || chr(10) || chr(10) || '   .. step:: Last' || chr(10) || chr(10) || '      done' || chr(10) AS content FROM documents")
def yaml_steps(spark, sf_dir):
    """Step files of several documents, a malformed one among them."""
    k = F.col("doc_id").cast("string")
    content = F.concat(F.lit("title: First "), k, F.lit("\npre: |\n  go\n    on\naction:\n  - heading: x\n---\nno: y\nbad line\n---\ntitle: 'Last'\npost: done\n"))
    return rst.rendered_step_files(X.table(spark, sf_dir, "documents").select(F.concat(F.lit("steps-"), k, F.lit(".yaml")).alias("path"), content.alias("content")))


@query(DOCS + f" SELECT '{ROOT}includes/i' || m || '.rst' AS path, 1 AS n FROM (SELECT DISTINCT a AS m FROM d UNION SELECT DISTINCT a + 1 FROM d WHERE a % 2 = 1) UNION ALL SELECT '{ROOT}includes/steps-s' || b || '.yaml', 1 FROM (SELECT DISTINCT b FROM d) UNION ALL SELECT path, 1 FROM d")
def followed_files(spark, sf_dir):
    found = includes.followed(_files(spark, sf_dir), _pages(spark, sf_dir).select("path"))
    return found.select("path", F.lit(1).alias("n"))


# --- usage ---------------------------------------------------------------------------------------------------------


def _usages(spark, sf_dir):
    edges = directives.edge_table(_pages(spark, sf_dir))
    return includes.resolve_includes(edges, _files(spark, sf_dir))


@query(DOCS + " SELECT path AS source, 'literalinclude' AS directive, CAST(1 AS BIGINT) AS usages FROM d WHERE b = 1")
def usages_of_type(spark, sf_dir):
    return graph.usages_by_file(graph.usages(_usages(spark, sf_dir), ROOT + "includes/c1.py", "literalinclude"))


@query(DOCS + " SELECT '[literalinclude] ' || path || ':12' AS value FROM d WHERE b = 1")
def usage_lines(spark, sf_dir):
    return sinks.usage_lines(graph.usages(_usages(spark, sf_dir), ROOT + "includes/c1.py"))


@query(DOCS + " SELECT path AS value FROM d WHERE b = 2 AND k % 10 <> 7")
def usage_paths(spark, sf_dir):
    """Paths of a file's users, those under excluded globs left out."""
    found = paths.without_excluded(graph.usages(_usages(spark, sf_dir), ROOT + "includes/c2.py"), ["**/*7.txt"])
    return sinks.usage_paths(found)


@query(DOCS + " SELECT path AS page, CASE WHEN a = 4 THEN 1 ELSE 2 END AS depth FROM d WHERE a IN (3, 4)")
def pages_using(spark, sf_dir):
    """Pages that use a file directly or through another one."""
    edges = directives.edge_table(_files(spark, sf_dir))
    found = includes.resolve_includes(edges, _files(spark, sf_dir)).where(F.col("target").isNotNull())
    return graph.pages_using(found.select("source", "target"), ROOT + "includes/i4.rst")


# --- source folders ------------------------------------------------------------------------------------------------


def _places(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.when(k % 3 == 0, "/v1/").when(k % 3 == 1, "/manual/").otherwise("/")
    return X.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("content/p"), (k % 5).cast("string"), version, F.when(k % 7 == 0, "notes/x").otherwise("source/a/source/f"), k.cast("string"), F.lit(".txt")).alias("path"))


PLACED = "WITH s AS (SELECT p_partkey AS k, 'content/p' || (p_partkey % 5) AS p, CASE p_partkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'manual' END AS v FROM part)"


@query(PLACED + " SELECT k AS p_partkey, CASE WHEN k % 7 <> 0 THEN concat_ws('/', p, v, 'source/a/source') END AS source_dir, CASE WHEN k % 7 <> 0 THEN concat_ws('/', p, v, 'source/a') END AS product_dir FROM s")
def source_dirs(spark, sf_dir):
    """The nearest folder named source; here that isn't the outermost one."""
    path = F.col("path")
    return _places(spark, sf_dir).select("p_partkey", includes.source_dir(path).alias("source_dir"), includes.product_dir(path).alias("product_dir"))


def _versioned(spark, sf_dir):
    return _places(spark, sf_dir).select(F.replace("path", F.lit("source/a/source/"), F.lit("source/")).alias("path"))


@query(PLACED + " SELECT DISTINCT p AS product, v AS version FROM s WHERE k % 7 <> 0")
def versions_of_products(spark, sf_dir):
    return includes.versions_of(_versioned(spark, sf_dir))


@query(PLACED + " SELECT DISTINCT v AS version, concat_ws('/', p, v, 'source/f12.txt') AS path, coalesce(v = 'v1', false) AS found FROM s WHERE k % 7 <> 0 AND p = 'content/p2'")
def version_paths(spark, sf_dir):
    return includes.version_paths(_versioned(spark, sf_dir), "content/p2", "f12.txt")


@query("SELECT 'shell-tool' AS product, CAST(count(*) AS BIGINT) AS count FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'sync', count(*) FROM part WHERE p_partkey % 2 = 1")
def special_products(spark, sf_dir):
    """Languages whose examples count for a product of their own."""
    k = F.col("p_partkey")
    files = X.table(spark, sf_dir, "part").select(F.concat(F.lit("content/code-examples/tested/"), F.when(k % 2 == 0, "shell-tool/any").otherwise("go/sync"), F.lit("/f"), k.cast("string"), F.lit(".go")).alias("path"))
    known = spark.createDataFrame([("shell-tool", None), ("sync", [".go"])], "product string, extensions array<string>")
    return paths.tested_examples(files, known, special={"shell-tool": "shell-tool"})


@query("SELECT doc_id, 'f' || doc_id || '.js' AS name FROM documents")
def path_templates(spark, sf_dir):
    k = F.col("doc_id")
    path = F.concat(F.lit("a/b/f"), k.cast("string"), F.lit(".js"))
    return X.table(spark, sf_dir, "documents").select("doc_id", S.fill_path("${filename}", path).alias("name"))
