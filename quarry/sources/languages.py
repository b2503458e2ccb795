"""What a scan looks for in each language: extensions, folders left out, markers of routes and callables, frameworks."""

from __future__ import annotations

#: Extensions, and folders that the walk of one language leaves out (folders that begin with a dot always are).
EXTENSIONS = {"python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js",), "java": ("java",), "csharp": ("cs",), "go": ("go",), "rust": ("rs",)}
LEFT_OUT = ("node_modules", ".git", ".venv", "venv", "dist", "build", "target", "bin", "obj")
LEFT_OUT_MORE = {"typescript": (".next", "out"), "go": ("vendor",)}

#: Byte strings of which a file with routes holds at least one.
ROUTES = {
    "python": ("@app.", "@router.", "@blueprint.", "@bp.", ".route(", ".api_route(", "add_url_rule", "path(", "re_path(", "url(", "router.add_get", "router.add_post", "router.add_put",
               "router.add_delete", "router.add_patch", "MethodView", "RequestHandler", "Resource", "@get(", "@post(", "@put(", "@patch(", "@delete("),
    "typescript": (".get(", ".post(", ".put(", ".patch(", ".delete(", "router.get", "router.post", "router.put", "router.patch", "router.delete", "app.get(", "app.post(", "app.put(",
                   "app.patch(", "app.delete(", "server.route(", ".route(", "@Get(", "@Post(", "@Put(", "@Patch(", "@Delete(", "@Controller(", "@Controller()", "NextApiRequest", "NextApiResponse"),
    "javascript": (".get(", ".post(", ".put(", ".patch(", ".delete(", "router.get", "app.get(", "app.post(", "server.route(", ".route("),
    "java": ("@GetMapping", "@PostMapping", "@PutMapping", "@PatchMapping", "@DeleteMapping", "@RequestMapping", "@GET", "@POST", "@PUT", "@PATCH", "@DELETE", "@Path(", "@Get(", "@Post(",
             "@Put(", "@Delete(", "router.get(", "router.post("),
    "csharp": ("[HttpGet", "[HttpPost", "[HttpPut", "[HttpPatch", "[HttpDelete", "[Route(", "[ApiController", "MapGet(", "MapPost(", "MapPut(", "MapPatch(", "MapDelete(", "app.Map", "endpoints.Map"),
    "go": ("r.GET(", "r.POST(", "r.PUT(", "r.PATCH(", "r.DELETE(", "router.GET(", "router.POST(", "engine.GET(", "e.GET(", "e.POST(", "g.GET(", "g.POST(", "r.Get(", "r.Post(", "app.Get(",
           "app.Post(", "http.HandleFunc(", "http.Handle(", "mux.HandleFunc(", "mux.Handle(", ".HandleFunc(", "beego.Router("),
    "rust": ("#[get(", "#[post(", "#[put(", "#[patch(", "#[delete(", "#[route(", "web::get()", "web::post()", ".route(\"", "Router::new()", "#[handler]", "warp::path(", "#[actix_web::get",
             "#[actix_web::post"),
}
#: Byte strings of files with callables; a scan that wants functions adds them for Python only.
CALLABLES = {
    "python": ("def ", "async def ", "class "),
    "typescript": ("export function", "export async function", "export class", "export const"),
    "javascript": ("module.exports", "exports.", "function ", "const "),
    "java": ("public ", "protected ", "ResponseEntity"),
    "csharp": ("public ", "static ", "async Task", "IActionResult"),
    "go": ("func ", "func("),
    "rust": ("pub fn ", "pub async fn ", "fn ", "async fn "),
}
#: Frameworks by language, in order, with the strings that show them.
FRAMEWORKS = {
    "python": (("fastapi", ("fastapi", "from fastapi")), ("flask", ("from flask", "import flask")), ("django", ("from django", "django.urls")), ("starlette", ("from starlette", "starlette.")),
               ("typer", ("import typer", "typer.Typer")), ("click", ("import click", "@click.command"))),
    "typescript": (("express", ("from 'express'", 'from "express"', "require('express')", 'require("express")')), ("fastify", ("from 'fastify'", 'from "fastify"', "fastify()", "Fastify()")),
                   ("nestjs", ("@nestjs/", "@Controller", "@Get(", "@Post(")), ("koa", ("from 'koa'", "from '@koa/router'", "koa-router", 'require("koa")')),
                   ("hapi", ("@hapi/hapi", "from 'hapi'", 'from "@hapi/hapi"')), ("hono", ("from 'hono'", 'from "hono"', "new Hono(")),
                   ("next", ("NextApiRequest", "NextApiResponse", "next/server", "app/api")), ("loopback", ("@loopback/rest", "@loopback/core")),
                   ("restify", ("from 'restify'", 'require("restify")')), ("sails", ("sails.config.routes",))),
    "java": (("spring", ("@SpringBootApplication", "springframework", "@RestController", "@Controller", "@RequestMapping")), ("jaxrs", ("javax.ws.rs", "jakarta.ws.rs", "@Path", "jax-rs")),
             ("micronaut", ("io.micronaut", "@Controller", "micronaut.http")), ("quarkus", ("io.quarkus", "quarkus.http")), ("javalin", ("io.javalin", "Javalin.create", "app.get(")),
             ("vertx", ("io.vertx", "vertx.web", "Router.router")), ("spark", ("spark.Spark", "import static spark.Spark")), ("dropwizard", ("io.dropwizard",)), ("helidon", ("io.helidon",))),
    "csharp": (("aspnet", ("Microsoft.AspNetCore", "[ApiController]", "ControllerBase")), ("minimalapi", ("WebApplication", "app.MapGet", "app.MapPost")),
               ("mvc", ("Controller", "ActionResult", "IActionResult"))),
    "go": (("gin", ("github.com/gin-gonic/gin", "gin.Default()", "gin.New()")), ("echo", ("github.com/labstack/echo", "echo.New()")), ("chi", ("github.com/go-chi/chi",)),
           ("fiber", ("github.com/gofiber/fiber",)), ("gorilla", ("github.com/gorilla/mux",)), ("httprouter", ("github.com/julienschmidt/httprouter",)), ("fasthttp", ("github.com/valyala/fasthttp",)),
           ("iris", ("github.com/kataras/iris",)), ("beego", ("github.com/beego/beego", "beego.Router")), ("stdlib", ("net/http", "http.HandleFunc", "http.Handle"))),
    "rust": (("actix", ("actix-web", "actix_web", "use actix", "HttpServer::new")), ("rocket", ("rocket", "#[rocket", "rocket::build")), ("axum", ("axum", "Router::new", "axum::Router")),
             ("poem", ("poem", "poem_openapi", "Route::new")), ("warp", ("warp", "warp::path", "warp::filter")), ("tide", ("tide", "tide::new")), ("salvo", ("salvo", "salvo_core")),
             ("loco", ("loco_rs", "loco::prelude"))),
}


def needles(language: str, functions: bool = False) -> tuple[str, ...]:
    """What the sniff looks for; a scan for functions adds callables in Python only."""
    return ROUTES[language] + (CALLABLES[language] if functions and language == "python" else ())


def left_out(language: str) -> tuple[str, ...]:
    return LEFT_OUT + LEFT_OUT_MORE.get(language, ())


def hints(language: str) -> list[tuple[str, str]]:
    """(framework, hint) rows for ``operators.files.frameworks``."""
    return [(name, hint) for name, listed in FRAMEWORKS.get(language, ()) for hint in listed]
