"""Where rows come from: tables, derived graph views, files."""
