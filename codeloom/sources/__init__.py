"""Where graphs come from: snapshot store, table fixtures, manifests."""
