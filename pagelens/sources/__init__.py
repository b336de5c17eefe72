from pagelens.sources.pages import read_pages, read_table, parse_pages, split_parsed

__all__ = ["read_pages", "read_table", "parse_pages", "split_parsed"]
