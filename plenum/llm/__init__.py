"""Training-data operators: each module holds one operator; ``queries`` lists the registered queries."""
