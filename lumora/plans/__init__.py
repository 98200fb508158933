"""How instructions get their meaning: rules that are columns, or a model that is asked."""
