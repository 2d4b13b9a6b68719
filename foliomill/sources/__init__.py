"""Where rows come from: folders, manifests, archives, images, runs."""
