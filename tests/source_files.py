"""Source files, each a case of the extractors, and what they give."""

#: Repositories of a file or more; each names what it must give.
FILES = [
    ("a/py", "Python", "src/s.py", '@mcp.tool()\ndef add(a: int, b: str = "x"):\n    """Adds."""\n\n@mcp.tool()\ndef quiet(a): pass\n\nTool(name="q", description="d", inputSchema={"type": "object"})\n'),
    ("a/py", "Python", "src/t.py", 'mcp.tool()(later)\nmcp.add_tool(FunctionTool.from_function(f))\ndef f(x: Optional[int]):\n    """F."""\n'),
    ("a/py", "Python", "src/u.py", 'def later():\n    """Later."""\n'),
    ("a/py", "Python", "tests/v.py", '@tool\ndef hidden():\n    """No."""\n'),
    ("a/ts", "TypeScript", "i.ts", 'server.tool("one", "first", {}, h); makeTool("two", `second`);\nserver.tool("three", { a: z.string() }, h);\nx = tool("four", { description: "d" });\n'),
    ("a/ts", "TypeScript", "j.ts", 'const N = "seven";\nserver.addTool({ name: "five", description: `a {b}` });\ns.registerTool("six", { description: "6" }, h);\nserver.setRequestHandler(ListToolsRequestSchema, async () => { return { tools: [{ name: N, description: "7" }] }; });\n'),
    ("a/go", "Go", "m.go", 'const Foo = "vary"\nt := mcp.NewTool("new", mcp.WithDescription("n"))\nu := mcp.NewTool(Foo, mcp.WithDescription("v"))\nv := mcp.Tool{Name: "held", Description: "h"}\nsrv.RegisterTool("reg", "r", f)\n'),
    ("a/rs", "Rust", "l.rs", '#[tool(description = "does")]\npub async fn act(&self) {}\nlet t = Tool::new("built").description("b");\n'),
    ("a/nb", "Jupyter Notebook", "n.ipynb", '{"cells": [{"cell_type": "code", "source": ["@mcp.tool()\\n", "def cell(a):\\n", "    \\"\\"\\"C.\\"\\"\\"\\n"]}]}'),
    ("a/js", None, "p.json", '{"name": "gen", "description": "g", "inputSchema": {"type": "object"}}'),
]
#: What they give, by reading.
EXPECTED = [
    ("a/py", "src/s.py", "add", "Adds.", "python-ast-decorator"), ("a/py", "src/s.py", "q", "d", "python-ast-tool-object"), ("a/py", "src/t.py", "f", "F.", "python-ast-function-tool"),
    ("a/py", "src/u.py", "later", "Later.", "python-ast-mcp-tool-call"), ("a/ts", "i.ts", "one", "first", "ts-regex-server-tool"), ("a/ts", "i.ts", "two", "second", "ts-regex-factory"),
    ("a/ts", "i.ts", "three", "", "ts-tool-call-nameonly"), ("a/ts", "i.ts", "four", "", "ts-core-tool"), ("a/ts", "j.ts", "five", "a {b}", "ts-addtool"), ("a/ts", "j.ts", "six", "6", "ts-registertool"),
    ("a/ts", "j.ts", "seven", "7", "ts-listtoolshandler"), ("a/go", "m.go", "new", "n", "go-regex-newtool"), ("a/go", "m.go", "vary", "v", "go-regex-newtool-var"), ("a/go", "m.go", "held", "h", "go-regex-tool-struct"),
    ("a/go", "m.go", "reg", "r", "go-regex-registertool"), ("a/rs", "l.rs", "act", "does", "rust-attr-macro"), ("a/rs", "l.rs", "built", "b", "rust-tool-builder"), ("a/nb", "n.ipynb", "cell", "C.", "python-ast-decorator"),
    ("a/js", "p.json", "gen", "g", "generic-inputSchema-search"),
]
