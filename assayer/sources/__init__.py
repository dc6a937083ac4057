"""Where rows come from and where results go."""
