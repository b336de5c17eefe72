from pagelens.functions.text import collapse, js_quote, text_slice
from pagelens.functions.url import resolve_href, url_host, url_path

__all__ = ["collapse", "js_quote", "text_slice", "resolve_href", "url_host", "url_path"]
