"""Plan builders: DataFrame in, DataFrame out, nothing executed unless stated."""
