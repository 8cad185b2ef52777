"""Go routes, infrastructure files, facts of broken files, facts of other extractors."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import go_routes, http
from lattica.plans import facts as facts_table, index as plan
from lattica.sources import infra
from lattica.sources.files import list_files, python_facts, read_texts

CHI = """func Routes(r chi.Router) {
	r.Route("/shop", func(r chi.Router) {
		r.Get("/alive", alive)
		r.Route("/carts", func(c chi.Router) {
			c.Get("/", list) // a brace in a comment: }
			c.Post("/{id}", "not a handler: {")
			c.Put("/{id}/items",
				check,
				put)
		})
		r.Delete("/last", func(w http.ResponseWriter, q *http.Request) { fmt.Println("{{") })
	})
	r.Get("/outside", out)
	http.Get("/sent")
	cache.Get("key")
}
"""
GIN = 'func Register(r *gin.RouterGroup) {\n\torders := r.Group("/orders")\n\tlines := orders.Group("/lines/")\n\torders.GET("/:id", get)\n\torders.POST("", create)\n\tlines.Any("open", auth, open)\n}\n'
MAIN = 'func main() {\n\tRegister(r.Group("/api"))\n\tv1 := r.Group("/v1")\n\tOther(v1)\n\tpkg.More(v1, 3)\n\tv2 := v1.Group("/x")\n\tDeep(v2)\n}\n'


def go(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "qualified_name string, text string")


def test_go_blocks_and_groups(spark):
    rows = {(r["method"], r["path"], r["handler"]) for r in go_routes.go_routes(go(spark, chi=CHI)).collect()}
    assert rows == {("GET", "/shop/alive", "alive"), ("GET", "/shop/carts", "list"), ("POST", "/shop/carts/{id}", ""), ("PUT", "/shop/carts/{id}/items", "put"), ("DELETE", "/shop/last", ""), ("GET", "/outside", "out")}
    rows = {(r["method"], r["path"], r["variable"], r["handler"]) for r in go_routes.go_routes(go(spark, gin=GIN)).collect()}
    assert rows == {("GET", "/orders/:id", "r", "get"), ("POST", "/orders", "r", "create"), ("", "/orders/lines/open", "r", "open")}
    mounts = {(r["callee"], r["prefix"]) for r in go_routes.go_mounts(go(spark, main=MAIN)).collect()}
    assert mounts == {("Register", "/api"), ("Other", "/v1"), ("pkg.More", "/v1"), ("Deep", "/v1/x")}
    assert go_routes.go_routes(go(spark, a="", b="func f() {}")).count() == 0


def test_empty_paths_and_several_lines(spark):
    src = [("py", "python", '@router.get("")\n@router.post(\n  path="/x/",\n  tags=["a"])\n@bp.route(\'/y\', methods=["GET"])'), ("js", "javascript", "router.get('', list)\nrouter.put(`/z`,\n  check, put)\nreq.get('/no', 1)"), ("java", "java", '@GetMapping(path = "/u")\n@PostMapping({"/v"})')]
    found = {(r["qualified_name"], r["method"], r["path"], r["router"]) for r in http.extract_routes(spark.createDataFrame(src, "qualified_name string, language string, text string")).collect()}
    assert found == {("py", "GET", "", "router"), ("py", "POST", "/x/", "router"), ("py", "", "/y", "bp"), ("js", "GET", "", "router"), ("js", "PUT", "/z", "router"), ("java", "GET", "/u", ""), ("java", "POST", "/v", "")}


COMPOSE = """
services:
  api:
    build:
      context: ./api
    ports:
      - "8080:80"
    environment:
      PORT: "80"
      JWT_SECRET: "abc"
    depends_on:
      - db
    networks: [back, "front"]
    container_name: my-api
  web:
    build: ./web
    depends_on:
      api:
        condition: service_healthy
      cache:
        condition: service_started

  db:
    image: 'postgres:15' # pinned
    expose: ["5432"]
    environment:
    - POSTGRES_DB=main
    - POSTGRES_PASSWORD=x
networks:
  back:
"""
BUILD = """
substitutions:
  _SERVICE_NAME: orders
  _TOKEN: x
steps:
- name: docker
  args: ['build', '-t', 'img', '.']
- name: sdk
  entrypoint: bash
  args:
  - "-c"
  - |
    gcloud run deploy $_SERVICE_NAME \\
      --region=europe-west3 \\
      --memory 2Gi \\
      --set-env-vars=LEVEL=INFO,API_KEY=x,MODE=a=b
images: ['eu.gcr.io/p/orders', other]
"""
TERRAFORM = """# a file
terraform {
  required_providers {
    google = {
      source = "hashicorp/google"
    }
  }
  backend "gcs" {
    bucket = "b"
  }
}
variable "region" {
  description = "Where } it runs"
  type        = string
  default     = "eu"
}
variable "api_key" { default = "x" }
resource "google_cloud_run_service" "main" {
  name = var.region // {
}
data "google_project" "here" {
}
module "vpc" {
  source = "./modules/vpc"
}
output "url" { value = 1 }
locals {
  env = "prod"
}
"""


def infra_properties(spark, **files):
    rows = spark.createDataFrame([("p", path.replace("__", "/").replace("_", ".", 1), text) for path, text in files.items()], "project string, rel_path string, text string")
    return {r["qualified_name"].removeprefix("p.__infra__."): json.loads(r["properties"]) for r in infra.infra_nodes(infra.infra_facts(rows)).collect()}


def test_compose_cloudbuild_and_terraform(spark):
    files = [("docker-compose.yml", COMPOSE), ("ci/cloudbuild.yaml", BUILD), ("infra/main.tf", TERRAFORM), ("empty.tf", "# nothing\n"), ("Dockerfile", "FROM golang:1 AS build\nFROM --platform=x alpine:3\nEXPOSE 80\nENV MODE=y\n"), ("run.sh", "#!/bin/sh\nexport A=b\ndocker build .\n. ./env.sh\n"), ("x.yaml", COMPOSE)]
    rows = spark.createDataFrame([("p", *f) for f in files], "project string, rel_path string, text string")
    got = {r["qualified_name"].removeprefix("p.__infra__."): json.loads(r["properties"]) for r in infra.infra_nodes(infra.infra_facts(rows)).collect()}
    assert got["docker-compose.yml.api"] == {"build_context": "./api", "ports": ["8080:80"], "environment": {"PORT": "80"}, "depends_on": ["db"], "networks": ["back", "front"], "container_name": "my-api"}
    assert got["docker-compose.yml.web"] == {"build_context": "./web", "depends_on": ["api", "cache"]}
    assert got["docker-compose.yml.db"] == {"image": "postgres:15", "expose": ["5432"], "environment": {"POSTGRES_DB": "main"}}
    assert got["ci.cloudbuild.yaml"] == {"substitutions": {"_SERVICE_NAME": "orders"}, "service_name": "orders", "image_registry": "eu.gcr.io/p/orders", "deploy_region": "europe-west3", "deploy_memory": "2Gi", "deploy_env_vars": {"LEVEL": "INFO", "MODE": "a=b"}}
    assert got["infra.main.tf"] == {"backend": "gcs", "variables": ["api_key", "region"], "variable_types": {"region": "string"}, "variable_defaults": {"region": "eu"}, "resources": ["google_cloud_run_service.main"], "data_sources": ["google_project.here"], "modules": ["vpc"], "module_sources": {"vpc": "./modules/vpc"}, "outputs": ["url"], "has_locals": True}
    assert got["Dockerfile"]["base_image"] == "alpine:3" and got["Dockerfile"]["base_images"] == ["alpine:3", "golang:1"] and got["Dockerfile"]["stages"] == ["build"]
    assert got["run.sh"] == {"shebang": "/bin/sh", "variables": ["A"], "docker_commands": ["docker build"], "sources": ["./env.sh"]}
    assert set(got) == {"docker-compose.yml.api", "docker-compose.yml.web", "docker-compose.yml.db", "ci.cloudbuild.yaml", "infra.main.tf", "Dockerfile", "run.sh"}


def test_files_that_are_deep_broken_or_no_text(spark):
    deep = "x = " + " + ".join(["a"] * 3000) + "\n\ndef f():\n    return " + ".b" .join(["g"] + [""] * 200) + "\n"
    files = spark.createDataFrame([("p", "deep.py", deep), ("p", "broken.py", "def (")], "project string, rel_path string, text string")
    facts = python_facts(files, errors=True)
    assert {(r["rel_path"], r["kind"]) for r in facts.where("kind in ('definition', 'error')").select("rel_path", "kind").collect()} == {("deep.py", "definition"), ("broken.py", "error")}
    assert facts.where("kind = 'read' and rel_path = 'deep.py'").count() > 2999


def test_listing_never_enters_ignored_folders(spark, tmp_path):
    for path, text in {".gitignore": "/secret/\n*.log\n", "a.py": "", "secret/b.py": "", "secret/.gitignore": "!b.py", "node_modules/c/d.py": "", "x/y/z/deep.py": "", "x/.gitignore": "z/*\n!z/deep.py\n", "x/y/z/no.py": "", "l.log": "", "bin.dat": "a\0b", "latin.py": None}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"# caf\xe9\n" if text is None else text.encode())
    (tmp_path / "secret").chmod(0o755)
    for entries in (20_000, 1):  # one folder after another
        found = list_files(spark, str(tmp_path), entries=entries)
        assert {r["rel_path"] for r in found.collect()} == {".gitignore", "a.py", "x/y/z/deep.py", "x/y/z/no.py", "x/.gitignore", "bin.dat", "latin.py"}
    texts = {r["rel_path"]: r["text"] for r in read_texts(str(tmp_path), found).collect()}
    assert texts["latin.py"] == "# caf�\n" and "bin.dat" not in texts


def test_facts_of_two_languages(spark):
    """An index from tables that other extractors filled: a Go service that mounts routes,
    and a script that calls it; types resolved elsewhere make stubs."""
    row = lambda path, kind, name="", qn="", label="", owner="", detail="", extra=(): ("p", path, kind, name, qn, label, 1, 9, owner, detail, list(extra))
    rows = [
        row("cmd/main.go", "file"), row("shop/routes.go", "file"), row("web/client.js", "file"),
        row("cmd/main.go", "definition", "setup", "p.cmd.main.setup", "Function"), row("cmd/main.go", "body", "go", "p.cmd.main.setup", "Function", "p.cmd.main", 'func setup(r *gin.Engine) {\n v := r.Group("/api")\n Register(v)\n}'),
        row("cmd/main.go", "call", "Register", owner="p.cmd.main.setup", detail="p.cmd.main"), row("cmd/main.go", "typed_call", "gin.Default", "ext.gin.Default", "lsp_types", "p.cmd.main.setup", "p.cmd.main"),
        row("shop/routes.go", "definition", "Register", "p.shop.routes.Register", "Function"), row("shop/routes.go", "body", "go", "p.shop.routes.Register", "Function", "p.shop.routes", 'func Register(rg *gin.RouterGroup) {\n rg.GET("/orders/:id", GetOrder)\n rg.POST("/inline", func(c *gin.Context) {})\n}'),
        row("shop/routes.go", "definition", "GetOrder", "p.shop.routes.GetOrder", "Function"), row("shop/routes.go", "body", "go", "p.shop.routes.GetOrder", "Function", "p.shop.routes", "func GetOrder(c *gin.Context) {}"),
        row("web/client.js", "definition", "load", "p.web.client.load", "Function"), row("web/client.js", "body", "javascript", "p.web.client.load", "Function", "p.web.client", 'const load = () => fetch("http://shop.local/api/orders/7")'),
        row("web/client.js", "call", "fetch", owner="p.web.client.load", detail="p.web.client"),
    ]
    table = facts_table.checked(spark.createDataFrame(rows, facts_table.FACT_SCHEMA))
    graph, _ = plan.graph_of_facts(facts_table.with_code(table))
    names = {r["id"]: r["qualified_name"] for r in graph.nodes.collect()}
    edges = {(r["type"], names[r["source_id"]], names[r["target_id"]]): json.loads(r["properties"]) for r in graph.edges.collect()}
    assert ("HANDLES", "p.shop.routes.GetOrder", "p.__route__.GET./api/orders/:id") in edges and ("HANDLES", "p.shop.routes.Register", "p.__route__.POST./api/inline") in edges
    assert ("HTTP_CALLS", "p.web.client.load", "p.shop.routes.GetOrder") in edges
    assert edges["CALLS", "p.cmd.main.setup", "ext.gin.Default"]["resolution_strategy"] == "lsp_types" and graph.nodes.where("qualified_name = 'ext.gin.Default'").first()["properties"] == '{"stub":true}'
    assert edges["CALLS", "p.shop.routes.Register", "p.shop.routes.GetOrder"] == {"via": "route_registration"}
    for wrong in ([row("a.go", "file"), row("a.go", "nonsense")], [row("a.go", "call")]):
        with pytest.raises(ValueError):
            facts_table.checked(spark.createDataFrame(wrong, facts_table.FACT_SCHEMA))
    with pytest.raises(ValueError):
        facts_table.checked(spark.createDataFrame([("x",)], "kind string"))


def test_long_keys_meet_by_their_first_words(spark):
    from lattica.operators import joins

    words = "_".join(f"w{i}" for i in range(20))
    texts = spark.createDataFrame([(1, f"a_{words}_b"), (2, words.replace("w19", "x")), (3, "w1_w2")], "id long, t string")
    keys = spark.createDataFrame([(words,), ("w1_w2",), ("w1",), ("1_w2",)], "k string")
    assert {(r["id"], r["k"]) for r in joins.containing(texts, keys, "t", "k").collect()} == {(1, words), (1, "w1_w2"), (1, "w1"), (2, "w1_w2"), (2, "w1"), (3, "w1_w2"), (3, "w1")}


def test_chains_of_returned_types(spark):
    from lattica.operators import derive

    known = spark.createDataFrame([("p", "p.a.Client", "Client", "Class"), ("p", "p.b.Session", "Session", "Class"), ("p", "p.c.Handle", "Handle", "Class"), ("p", "p.a.Client.session", "session", "Method"), ("p", "p.b.Session.open", "open", "Method"), ("p", "p.c.Handle.read", "read", "Method")], "project string, qualified_name string, name string, label string")
    returns = spark.createDataFrame([("p", "p.a.make", "Client"), ("p", "p.z.make", "Handle"), ("p", "p.a.Client.session", "Session"), ("p", "p.b.Session.open", "lib.Handle"), ("p", "p.a.nothing", "Unknown")], "project string, qualified_name string, type_name string")
    rows = [("p", "p.m", "a", "make"), ("p", "p.m", "b", "a.session"), ("p", "p.m", "c", "b.open"), ("p", "p.m", "d", "c.none"), ("p", "p.m", "e", "nothing"), ("p", "p.n", "a", "make"), ("p", "p.a", "x", "make"), ("p", "p.m", "f", "Handle")]
    assigns = spark.createDataFrame(rows, "project string, module_qn string, variable string, type_name string")
    maps = spark.createDataFrame([("p", "p.m", {"make": "p.a.make"})], "project string, module_qn string, imports map<string,string>")
    types = derive.variable_types(assigns, returns, known, maps)
    assert {(r["module_qn"], r["variable"], r["class_qn"]) for r in types.collect()} == {("p.m", "a", "p.a.Client"), ("p.m", "b", "p.b.Session"), ("p.m", "c", "p.c.Handle"), ("p.m", "f", "p.c.Handle"), ("p.a", "x", "p.a.Client")}
    calls = spark.createDataFrame([("p", "p.m.run", "p.m", "c.read"), ("p", "p.m.run", "p.m", "().read")], "project string, source_qn string, module_qn string, callee string")
    assert [r["target_qn"] for r in derive.method_calls(calls, types, known).collect()] == ["p.c.Handle.read"]
