"""Column functions: text, URLs, hosts, markup."""
